"""Maps derived from a stack of dates: frequency, persistence, change, transitions, composites. First and last dates are those of the stack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CELL, NODATA, OPERA_LAND, OPERA_PARTIAL, OPERA_VALID_BELOW, OPERA_WATER, ratio

WET = (OPERA_WATER, OPERA_PARTIAL)


def water_frequency(stack: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Percent of valid dates on which a cell was water, 0 if none was valid."""
    valid = F.col("cls") < OPERA_VALID_BELOW
    return stack.groupBy(*keys).agg((100.0 * ratio(F.count_if(valid & F.col("cls").isin(*WET)), F.count_if(valid))).alias("water_pct"))


def persistence(frequency: DataFrame, threshold: float = 95.0) -> DataFrame:
    """0 never water, 1 sometimes, 2 at least `threshold` percent of dates."""
    p = F.col("water_pct")
    return frequency.withColumn("persistence", F.when(p >= threshold, 2).when(p > 0, 1).otherwise(0))


def season_type(frequency: DataFrame) -> DataFrame:
    """2 always water, 1 sometimes, 0 never."""
    p = F.col("water_pct")
    return frequency.withColumn("season_type", F.when(p == 100, 2).when((p > 0) & (p < 100), 1).otherwise(0))


def shown_frequency(p: Column, least: float = 5.0) -> Column:
    return F.when(p >= least, p)


def end_dates(stack: DataFrame, n: int, last: bool = False, day: str = "obs_date") -> list:
    """The first (or, backwards, the last) n dates of the whole stack: n values, so that a scan of the stack can skip all others."""
    return [r[0] for r in stack.select(day).where(F.col(day).isNotNull()).distinct().orderBy(F.desc(day) if last else F.asc(day)).limit(n).collect()]


def water_change(stack: DataFrame, n_start: int = 3, n_end: int = 3, keys: Sequence[str] = CELL, day: str = "obs_date") -> DataFrame:
    """Share of water of each cell on the stack's last dates less that on its first; dates without data on a cell count as no water."""
    first, last = end_dates(stack, n_start, False, day), end_dates(stack, n_end, True, day)
    wet = F.col("cls").isin(*WET)
    share = lambda days, n: F.count_if(F.col(day).isin(days) & wet) / float(n)
    ends = stack.where(F.col(day).isin([*first, *last])).groupBy(*keys).agg((share(last, n_end) - share(first, n_start)).alias("change"))
    return stack.select(*keys).distinct().join(ends, list(keys), "left").withColumn("change", F.coalesce("change", F.lit(0.0)))


def first_valid(stack: DataFrame, n: int = 3, last: bool = False, keys: Sequence[str] = CELL, day: str = "obs_date", valid_to: int = OPERA_VALID_BELOW) -> DataFrame:
    """The first valid class of each cell among the first (or, backwards, the last) n dates of the stack; null if none is."""
    days = end_dates(stack, n, last, day)
    valid = stack.where(F.col(day).isin(days) & (F.col("cls") <= valid_to))
    found = valid.groupBy(*keys).agg((F.max_by if last else F.min_by)("cls", day).cast("int").alias("cls"))
    return stack.select(*keys).distinct().join(found, list(keys), "left")


def transitions(initial: Column, final: Column) -> Column:
    """Codes 0 to 7 of changes between land, water and partial water; null for others and where data are missing."""
    # Fixed values: (initial, final) by code.
    table = {(1, 1): 0, (0, 1): 1, (1, 0): 2, (2, 2): 3, (0, 2): 4, (2, 0): 5, (1, 2): 6, (2, 1): 7}
    out = F.when((initial == NODATA) | (final == NODATA), F.lit(None).cast("int"))
    for (a, b), code in table.items():
        out = out.when((initial == a) & (final == b), code)
    return out


def first_and_last(stack: DataFrame, keys: Sequence[str] = CELL, n: int = 3, day: str = "obs_date") -> DataFrame:
    """`initial` and `final`: composites of the stack's first and last n dates."""
    a = first_valid(stack, n, False, keys, day).withColumnRenamed("cls", "initial")
    return a.join(first_valid(stack, n, True, keys, day).withColumnRenamed("cls", "final"), list(keys))


def change_map(pairs: DataFrame, frequency: DataFrame, threshold: float = 95.0, keys: Sequence[str] = CELL) -> DataFrame:
    """final - initial; null where a cell was land in both or is persistent water."""
    x = pairs.join(persistence(frequency, threshold), list(keys))
    still = ((F.col("initial") == OPERA_LAND) & (F.col("final") == OPERA_LAND)) | (F.col("persistence") == 2)
    return x.select(*keys, F.when(~still, F.col("final") - F.col("initial")).alias("change"))


def pixel_series(stack: DataFrame, cell: dict[str, int], day: str = "obs_date", shown_to: int = 200) -> DataFrame:
    """A cell's classes by date, those above `shown_to` as missing."""
    x = stack
    for k, v in cell.items():
        x = x.where(F.col(k) == v)
    return x.select(day, F.when(F.col("cls") <= shown_to, F.col("cls")).alias("cls"))

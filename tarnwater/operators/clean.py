"""Cleaning of monthly composites: masks, temporal fill, removal of small water bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CELL, CLOUD, CONFIDENCE, HIGH_WATER, LAND, NODATA, WATER, CleanParams
from ..storage import stored
from .spatial import label_components


def densify(monthly: DataFrame, keys: Sequence[str] = CELL, month: str = "month_key") -> DataFrame:
    """A row for each cell and present month, nodata where there was none. Months are a short list and are broadcast."""
    months = monthly.select(month).distinct()
    grid = monthly.select(*keys).distinct().crossJoin(F.broadcast(months))
    return grid.join(monthly, [month, *keys], "left").withColumn("cls", F.coalesce("cls", F.lit(NODATA)))


def apply_masks(monthly: DataFrame, stats: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """`cleaned` and `confidence` behind the mask chain: ocean, persistent water, stable land. Masks that `stats` lacks are skipped."""
    present = [c for c in ("ocean", "persistent", "stable_land") if c in stats.columns]
    x = monthly.join(stats.select(*keys, *present, "mode_class"), list(keys), "left").withColumns({"cleaned": F.col("cls"), "confidence": F.lit(0)})
    for name, code in (("ocean", "ocean"), ("persistent", "persistent_water")):
        if name in present:
            on = F.coalesce(name, F.lit(False))
            x = x.withColumn("confidence", F.when(on & ~F.col("cleaned").isin(*WATER), F.greatest("confidence", F.lit(CONFIDENCE[code]))).otherwise(F.col("confidence")))
            x = x.withColumn("cleaned", F.when(on, 1).otherwise(F.col("cleaned")))
    if "stable_land" in present:
        on = F.coalesce("stable_land", F.lit(False)) & F.col("cleaned").isin(*HIGH_WATER)
        x = x.withColumn("confidence", F.when(on, F.greatest("confidence", F.lit(CONFIDENCE["stable_land"]))).otherwise(F.col("confidence")))
        x = x.withColumn("cleaned", F.when(on, LAND).otherwise(F.col("cleaned")))
    return x.drop(*present)


def temporal_fill(masked: DataFrame, params: CleanParams = CleanParams(), with_inwam: bool = True, keys: Sequence[str] = CELL, month: str = "month_key") -> DataFrame:
    """Fill cloud and nodata from the nearest month of the cell, the earlier first, else from its mode.

    Neighbours are values before the masks. With the INWAM layer, a copy of the composite, only high-confidence water fills. Offsets
    count months present; with calendar_offsets they count months.
    """
    order = W.partitionBy(*keys).orderBy(month)
    ok = (F.col("cls").isin(*HIGH_WATER)) if with_inwam else ~F.col("cls").isin(CLOUD, NODATA)
    x = masked.withColumn("_use", F.when(ok, F.col("cls")))
    if params.calendar_offsets:
        number = F.floor(F.col(month) / 100) * 12 + F.col(month) % 100
        span = W.partitionBy(*keys).orderBy(number)
        tries = [F.max("_use").over(span.rangeBetween(s, s)) for k in range(1, params.max_fill_months + 1) for s in (-k, k)]
    else:
        tries = [f("_use", k).over(order) for k in range(1, params.max_fill_months + 1) for f in (F.lag, F.lead)]
    x = x.withColumn("_near", F.coalesce(*tries))
    gap = F.col("cleaned").isin(CLOUD, NODATA)
    return x.withColumns(
        {
            "confidence": F.when(gap, F.greatest("confidence", F.when(F.col("_near").isNotNull(), CONFIDENCE["temporal_fill"]).otherwise(CONFIDENCE["fallback_mode"]))).otherwise(F.col("confidence")),
            "cleaned": F.when(gap, F.coalesce("_near", "mode_class", F.lit(NODATA))).otherwise(F.col("cleaned")),
        }
    ).drop("_use", "_near")


def remove_small_water(cleaned: DataFrame, params: CleanParams = CleanParams(), keys: Sequence[str] = CELL, month: str = "month_key", value: str = "cleaned") -> DataFrame:
    """Water bodies (8-connected) below the minimum become land; confidence stays."""
    cleaned = stored(cleaned, "filled")
    bodies = label_components(cleaned.where(F.col(value).isin(*WATER)).select(month, *keys), [month], keys, diagonal=True)
    small = bodies.join(bodies.groupBy(month, "component").agg(F.count("*").alias("_size")).where(F.col("_size") < params.min_water_pixels), [month, "component"]).select(month, *keys, F.lit(True).alias("_small"))
    return cleaned.join(small, [month, *keys], "left").withColumn(value, F.when(F.col("_small"), LAND).otherwise(F.col(value))).drop("_small")


def clean_monthly(monthly: DataFrame, stats: DataFrame, params: CleanParams = CleanParams(), with_inwam: bool = True, keys: Sequence[str] = CELL, month: str = "month_key") -> DataFrame:
    """(month, cell, cls, confidence): the whole chain."""
    masked = apply_masks(densify(monthly.select(month, *keys, "cls"), keys, month), stats, keys)
    filled = temporal_fill(masked, params, with_inwam, keys, month)
    return remove_small_water(filled, params, keys, month).select(month, *keys, F.col("cleaned").cast("int").alias("cls"), "confidence")

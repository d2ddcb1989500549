"""Daily quality control and the monthly vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CELL, CLOUD, HIGH_WATER, LAND, NODATA, PARTIAL, WATER, MonthlyParams, Product, ratio
from .merge import priority_merge


def _valid(cls: Column) -> Column:
    return ~cls.isin(CLOUD, NODATA)


def daily_quality(obs: DataFrame, stats: DataFrame, params: MonthlyParams = MonthlyParams(), keys: Sequence[str] = CELL, day: str = "obs_date", cells: int | None = None) -> DataFrame:
    """Shares of cloud, valid and water cells and of cells at odds with the statistics, and whether the date passes.

    Shares are of the cells observed on the date, or of `cells` if the grid's size is given. A valid cell is at odds with the
    statistics if it is water where water is improbable or the other way round; a date without valid cells doesn't pass.
    """
    s = stats.select(*keys, "water_prob")
    seen = obs.join(s, list(keys), "left").withColumn("_wet", F.coalesce("water_prob", F.lit(0.0)) >= params.water_prob)
    valid, water = _valid(F.col("cls")), F.col("cls").isin(*WATER)
    total = F.lit(cells) if cells else F.count("*")
    day_rows = seen.groupBy(day).agg(total.cast("long").alias("total"), F.count_if(F.col("cls") == CLOUD).alias("cloud"), F.count_if(valid).alias("valid"), F.count_if(water).alias("water"), F.count_if(valid & (water != F.col("_wet"))).alias("odd"))
    out = day_rows.select(day, ratio(F.col("cloud"), F.col("total")).alias("cloud_frac"), ratio(F.col("valid"), F.col("total")).alias("valid_frac"), ratio(F.col("water"), F.col("total")).alias("water_frac"), F.coalesce(F.try_divide(F.col("odd").cast("double"), F.col("valid").cast("double")), F.lit(1.0)).alias("mismatch"))
    ok = (F.col("cloud_frac") <= params.max_daily_cloud) & (F.col("valid_frac") >= params.min_daily_valid) & (F.col("mismatch") <= params.max_stats_mismatch)
    if params.min_daily_water > 0:
        ok = ok & (F.col("water_frac") >= params.min_daily_water)
    return out.withColumn("passes", ok)


def passing(obs: DataFrame, quality: DataFrame, day: str = "obs_date") -> DataFrame:
    """Observations of the dates that pass. Dates are days of a calendar, thousands at most, and are broadcast."""
    return obs.join(F.broadcast(quality.where("passes").select(day)), day, "left_semi")


def weight(cls: Column, inwam: Column) -> Column:
    """Confidence of an observation: by its INWAM class if it is water and has one, else by its own class; land 3."""
    table = lambda c, values: F.when(c == 1, values[0]).when(c == 2, values[1]).when(c == 3, values[2]).when(c == 4, values[3])
    own = F.coalesce(F.when(inwam.isin(1, 2, 3, 4), table(inwam, (4.0, 3.0, 2.0, 1.0))), table(cls, (3.5, 3.0, 2.0, 1.0)))
    return F.when(cls.isin(*WATER), own).when(cls == LAND, 3.0).otherwise(0.0)


def monthly_vote(obs: DataFrame, stats: DataFrame, params: MonthlyParams = MonthlyParams(), keys: Sequence[str] = CELL, month: str = "month_key") -> DataFrame:
    """One class per month and cell from its observations (cls, inwam) and the cell's statistics.

    One aggregate by month and cell, one join with the statistics, and a chain of expressions on its result.
    """
    c, w = F.col("cls"), F.col("_w")
    water = c.isin(*WATER)
    total = lambda pred, x=w: F.sum(F.when(pred, x).otherwise(0.0))
    votes = (
        obs.withColumn("_w", weight(c, F.col("inwam")))
        .groupBy(month, *keys)
        .agg(
            F.count("*").alias("n"), F.count_if(_valid(c)).alias("valid"), F.count_if(c == NODATA).alias("missing"),
            F.count_if(c.isin(*HIGH_WATER)).alias("wet"), F.count_if(c == PARTIAL).alias("part"), F.count_if(c == LAND).alias("dry"),
            F.count_if(water & (w >= 3)).alias("high"), F.count_if(water & (w >= 2)).alias("moderate"),
            total(water).alias("ww"), total(c == LAND).alias("lw"), F.coalesce(F.max(F.when(water, w)), F.lit(0.0)).alias("maxw"),
            *(total(c == k).alias(f"s{k}") for k in (1, 2, 3, 4)),
        )
    )
    s = stats.select(*keys, "persistent", "stable_land", "water_prob")
    x = votes.join(s, list(keys), "left").withColumns({"persistent": F.coalesce("persistent", F.lit(False)), "stable_land": F.coalesce("stable_land", F.lit(False)), "water_prob": F.coalesce("water_prob", F.lit(0.0))})
    x = x.withColumn("top", F.greatest("s1", "s2", "s3", "s4"))
    best = F.when((F.col("part") > 0) & (F.col("valid") > 0), PARTIAL)
    for k in (1, 2, 3, 4):
        best = best.when(F.col(f"s{k}") == F.col("top"), k)
    high, moderate, lead = ratio(F.col("high"), F.col("valid")), ratio(F.col("moderate"), F.col("valid")), F.col("ww") >= F.col("lw") + 2
    vote = ((F.col("high") >= 2) & (high >= 0.5)) | ((F.col("moderate") >= 3) & (moderate >= 0.6) & lead) | ((F.col("high") >= 1) & lead & (F.col("maxw") >= 3))
    vote = vote & (F.col("valid") >= 3) & (F.col("top") > 0) & (F.col("maxw") >= 2)
    free, wet, part = ~(F.col("persistent") | F.col("stable_land")), ratio(F.col("wet"), F.col("valid")), ratio(F.col("part"), F.col("valid"))
    to_water, to_part = wet >= params.water_fraction, part >= params.partial_fraction
    # Masks come first, then the fractions, then the vote, then missing and cloudy cells. Two further rules can't fire: that few
    # observations with a partial one make partial water (the vote says so already), and that evidence in probable water makes
    # water (evidence has made partial water before).
    first = F.when(F.col("persistent"), 1).when(F.col("stable_land"), LAND)
    first = first.when(to_water & to_part & (wet < part), PARTIAL).when(to_water, 1).when(to_part, PARTIAL).when(vote, best).when(F.col("missing") == F.col("n"), NODATA).when(F.col("valid") == 0, CLOUD).otherwise(LAND)
    x = x.withColumn("m", first)
    m = F.col("m")
    x = x.withColumn("m", F.when(free & (m == LAND) & ((F.col("wet") > 0) | (F.col("part") > 0)), PARTIAL).otherwise(m))
    wins = (F.col("part") > 0) & (F.col("part") > F.col("wet"))
    last = F.when(m.isin(*HIGH_WATER) & (ratio(F.col("part"), F.col("wet") + F.col("part")) >= 0.5) & (F.col("dry") > 0), PARTIAL)
    last = last.when((m == LAND) & wins, PARTIAL).when((m == LAND) & (F.col("wet") > 1) & ~(F.col("part") > F.col("wet")), 1).otherwise(m)
    return x.select(month, *keys, last.cast("int").alias("cls"))


def monthly_merge(daily: DataFrame, product: Product, keys: Sequence[str] = CELL, month: str = "month_key", order: str = "obs_date") -> DataFrame:
    """The plain alternative to the vote: a priority merge over a month's daily mosaics."""
    return priority_merge(daily, [month, *keys], product, order)

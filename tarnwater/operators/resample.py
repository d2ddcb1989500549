"""Resampling of hourly cubes, and filters of gauge series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_mean(cube: DataFrame, values: Sequence[str], keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return cube.groupBy(F.to_date(ts).alias("day"), *keys).agg(*(F.avg(v).alias(v) for v in values))


def week_end(ts: Column) -> Column:
    """The Sunday of a Monday-to-Sunday week."""
    return F.date_add(F.trunc(ts, "week"), 6)


def weekly(cube: DataFrame, sums: Sequence[str] = (), means: Sequence[str] = (), keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Sums and means by week, labelled by its Sunday."""
    return cube.groupBy(week_end(F.col(ts)).alias("week"), *keys).agg(*(F.sum(v).alias(v) for v in sums), *(F.avg(v).alias(v) for v in means))


def above(frame: DataFrame, value: str, least: float) -> DataFrame:
    """`value` where it is above a limit, else null."""
    return frame.withColumn(value, F.when(F.col(value) > least, F.col(value)))


def time_mean(cube: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return cube.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def of_version(cube: DataFrame, version: int = 1) -> DataFrame:
    """Rows of a cube that hold the final version, all of one without versions."""
    return cube.where(F.col("expver") == version).drop("expver") if "expver" in cube.columns else cube


def same_coordinates(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two cubes have the same cells."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def without_outliers(frame: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows strictly within `sigmas` population deviations of the mean; missing values go."""
    limits = frame.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    v = F.col(value)
    return frame.crossJoin(F.broadcast(limits)).where((v > F.col("_m") - sigmas * F.col("_s")) & (v < F.col("_m") + sigmas * F.col("_s"))).drop("_m", "_s")


def standard_error(frame: DataFrame, value: str) -> DataFrame:
    """1.96 standard errors of the mean."""
    return frame.agg((1.96 * F.stddev_pop(value) / F.sqrt(F.count(value).cast("double"))).alias("error"))


def together(**series: DataFrame) -> DataFrame:
    """Series on one time axis, each row with its source's name."""
    out = None
    for name, frame in series.items():
        part = frame.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

"""Per-cell statistics over time, and the masks derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CELL, NODATA, StatisticsParams, ratio
from .spatial import spread


def pixel_counts(obs: DataFrame, params: StatisticsParams = StatisticsParams(), keys: Sequence[str] = CELL) -> DataFrame:
    """Valid, water and cloud observations of each cell. Counts add up over any split of the dates."""
    valid = F.col("cls") != params.nodata
    return obs.groupBy(*keys).agg(F.count_if(valid).alias("valid_count"), F.count_if(valid & F.col("cls").isin(*params.water)).alias("water_count"), F.count_if(valid & (F.col("cls") == params.cloud)).alias("cloud_count"))


def weighted_counts(obs: DataFrame, params: StatisticsParams = StatisticsParams(), keys: Sequence[str] = CELL, layer: str = "inwam") -> DataFrame:
    """The counts with each observation weighing a quarter of its confidence class, nothing where that is missing."""
    valid = F.col("cls") != params.nodata
    weight = F.when(F.col(layer).isNull() | (F.col(layer) == NODATA), 0.0).otherwise(F.col(layer) / 4.0)
    total = lambda pred: F.sum(F.when(pred, weight).otherwise(0.0))
    return obs.groupBy(*keys).agg(total(valid).alias("valid_weight"), total(valid & F.col("cls").isin(*params.water)).alias("water_weight"), total(valid & (F.col("cls") == params.cloud)).alias("cloud_weight"))


def mode_class(obs: DataFrame, nodata: int = NODATA, keys: Sequence[str] = CELL) -> DataFrame:
    """The most frequent class, the lowest on ties, nodata where there is none. Counts by class first, so the shuffle carries counts."""
    counts = obs.groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    best = F.max_by(F.col("cls"), F.when(F.col("cls") != nodata, F.col("n") * 1024 - F.col("cls")))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(nodata)).cast("int").alias("mode_class"))


def masks(water_prob: Column, params: StatisticsParams = StatisticsParams()) -> dict[str, Column]:
    """Persistent water, stable land and ephemeral water; the last two overlap, and cells never seen are stable land."""
    return {"persistent": water_prob >= params.persistent, "stable_land": water_prob <= params.stable_land_max, "ephemeral": (water_prob >= params.ephemeral_min) & (water_prob < params.persistent)}


def water_statistics(obs: DataFrame, params: StatisticsParams = StatisticsParams(), keys: Sequence[str] = CELL) -> DataFrame:
    """Counts, water probability, cloud share, mode class and masks of each cell, from one aggregate by cell and class."""
    valid = F.col("cls") != params.nodata
    by_class = obs.groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    total = lambda pred: F.sum(F.when(pred, F.col("n")).otherwise(0))
    best = F.max_by(F.col("cls"), F.when(valid, F.col("n") * 1024 - F.col("cls")))
    counts = by_class.groupBy(*keys).agg(total(valid).alias("valid_count"), total(valid & F.col("cls").isin(*params.water)).alias("water_count"), total(valid & (F.col("cls") == params.cloud)).alias("cloud_count"), F.coalesce(best, F.lit(params.nodata)).cast("int").alias("mode_class"))
    out = counts.withColumn("water_prob", ratio(F.col("water_count"), F.col("valid_count"))).withColumn("cloud_frac", ratio(F.col("cloud_count"), F.col("valid_count")))
    return out.withColumns(masks(F.col("water_prob"), params))


def ocean_masks(stats: DataFrame, coast: DataFrame, radius: int, params: StatisticsParams = StatisticsParams(), keys: Sequence[str] = CELL) -> DataFrame:
    """Ocean (coast cells of high water probability) and the buffer of cells within `radius` cells of the coast.

    Each coast cell offers itself to the cells of its disk: an equi-join on cells, of coast x disk rows before they are made distinct.
    """
    shore = coast.select(*keys).distinct()
    disk = [(i, j, 0) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    near = spread(shore, [], disk, keys).drop("v").distinct().withColumn("_near", F.lit(True))
    out = stats.join(shore.withColumn("_coast", F.lit(True)), list(keys), "left").join(near, list(keys), "left")
    return out.select(*stats.columns, (F.coalesce("_coast", F.lit(False)) & (F.col("water_prob") >= params.ocean)).alias("ocean"), F.coalesce("_near", F.lit(False)).alias("shore_buffer"))


def class_histogram(obs: DataFrame, value: str = "cls") -> DataFrame:
    """Each value's count and share in percent."""
    counts = obs.groupBy(value).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def reference_grid(grids: DataFrame, order: str = "obs_date") -> DataFrame:
    """The grid of least area, the earliest on ties, from (width, height, order, ...)."""
    return grids.agg(F.min_by(F.struct(*grids.columns), F.struct((F.col("width").cast("long") * F.col("height")).alias("area"), F.col(order))).alias("g")).select("g.*")


def grid_sizes(grids: DataFrame) -> DataFrame:
    return grids.groupBy("width", "height").agg(F.count("*").alias("n"))

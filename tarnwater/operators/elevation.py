"""Elevations under the shoreline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CELL
from ..storage import stored
from .spatial import label_components, land_beside_water, remove_small


def dem_mode(dem: DataFrame) -> DataFrame:
    """The most frequent elevation that isn't negative, the lowest on ties: a lake's level in the model."""
    counts = dem.where("elev >= 0").groupBy("elev").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("elev", F.struct("n", (-F.col("elev")).alias("e"))).alias("level"))


def water_edges(grid: DataFrame, raster: Sequence[str], cells: int, keys: Sequence[str] = CELL, cloud_steps: int = 7, share: float = 0.001) -> DataFrame:
    """Shoreline cells of each raster (cls): small water bodies and small holes are evened out, shores near clouds left out.

    `cells` is the grid's size: bodies and holes below `share` of it go, and edge pieces below `share` of a raster's edge.
    """
    grid = stored(grid.select(*raster, *keys, "cls"), "grid")
    wet = remove_small(grid.where(F.col("cls").isin(1, 2)).select(*raster, *keys), raster, keys, share * cells)
    every = grid.select(*raster, *keys)
    dry = remove_small(every.join(wet, [*raster, *keys], "left_anti"), raster, keys, share * cells).withColumn("_dry", F.lit(True))
    state = grid.join(dry, [*raster, *keys], "left").withColumn("state", F.when(~F.col("cls").isin(0, 1, 2, 3), 5).when(F.col("_dry"), 0).otherwise(1))
    state = stored(state.select(*raster, *keys, "state"), "state")
    edge = stored(land_beside_water(state, raster, keys, cloud_steps=cloud_steps), "edge")
    least = edge.groupBy(*raster).agg((F.count("*") * share).alias("_least"))
    labelled = label_components(edge, raster, keys)
    sizes = labelled.groupBy(*raster, "component").agg(F.count("*").alias("_n")).join(least, list(raster)).where("_n >= _least")
    return labelled.join(sizes, [*raster, "component"], "left_semi").select(*raster, *keys)


def edge_elevation(edges: DataFrame, dem: DataFrame, level: DataFrame, raster: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Mode of rounded, median and deviation of exact elevations under a shoreline, without the lake's own level.

    Rounding is half to even; deviation is of the population; n counts all edge cells. Null unless two rounded values occur.
    """
    x = edges.join(dem.select(*keys, "elev"), list(keys)).crossJoin(F.broadcast(level)).withColumn("_round", F.rint("elev"))
    other = F.col("_round") != F.rint("level")
    counts = x.where(other).groupBy(*raster, "_round").agg(F.count("*").alias("c"))
    modes = counts.groupBy(*raster).agg(F.max_by("_round", F.struct("c", (-F.col("_round")).alias("r"))).alias("mode_elev"), F.count("*").alias("_k"))
    exact = F.when(F.col("elev") != F.col("level"), F.col("elev"))
    stats = x.groupBy(*raster).agg(F.median(exact).alias("median_elev"), F.stddev_pop(exact).alias("std_elev"), F.count("*").alias("n"))
    some = F.coalesce(F.col("_k") > 1, F.lit(False))
    return stats.join(modes, list(raster), "left").select(*raster, *(F.when(some, F.col(c)).alias(c) for c in ("median_elev", "mode_elev", "std_elev", "n")))


def elevation_summary(levels: DataFrame) -> DataFrame:
    return levels.agg(*(f(c).alias(f"{c}_{n}") for c in ("median_elev", "mode_elev") for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))

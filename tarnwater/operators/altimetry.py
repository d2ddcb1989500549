"""Altimetry lookups: nearest lake, nearest raster cell, preferences between names and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import inside, polygon_distance


def nearest_feature(features: DataFrame, x: float, y: float, most: float = 5000.0, by: Sequence[str] = ("file_id",), order: str = "lake_id", preferred: str | None = None, name: str = "lake_name") -> DataFrame:
    """The nearest feature of each file within a distance of the point, the first in order on ties; with `preferred`, by name first.

    Names that equal the preferred one come before names that contain it, and those before all others. Points (x_m, y_m) or rings.
    """
    distance = polygon_distance(F.lit(x), F.lit(y), F.col("ring")) if "ring" in features.columns else F.hypot(F.col("x_m") - x, F.col("y_m") - y)
    near = features.withColumn("distance", distance).where(F.col("distance") <= most)
    tier = name_tier(F.col(name), preferred) if preferred else F.lit(0)
    best = F.min_by(F.struct(*near.columns), F.struct(tier.alias("t"), F.col("distance"), F.col(order)))
    return near.groupBy(*by).agg(best.alias("s")).select("s.*")


def name_tier(name: Column, preferred: str) -> Column:
    return F.when(F.lower(name) == preferred.lower(), 0).when(F.lower(name).contains(preferred.lower()), 1).otherwise(2)


def containing_feature(features: DataFrame, x: float, y: float, order: str = "lake_id") -> DataFrame:
    """The first feature, in order, whose ring holds the point."""
    return features.where(inside(F.lit(x), F.lit(y), F.col("ring"))).orderBy(order).limit(1)


def first_match(features: DataFrame, text: str, by: Sequence[str] = ("file_id",), order: str = "lake_id", name: str = "lake_name") -> DataFrame:
    """The first feature of each file whose name holds the text, whatever the case."""
    hits = features.where(F.lower(name).contains(text.lower()))
    return hits.groupBy(*by).agg(F.min_by(F.struct(*features.columns), order).alias("s")).select("s.*")


def nearest_cell(swath: DataFrame, lat: float, lon: float, by: Sequence[str] = ("file_id",)) -> DataFrame:
    """Of each file whose bounds hold the point, the value at the cell nearest by |dlat| + |dlon|, the first in row-major order on ties."""
    l1 = F.abs(F.col("lat") - lat) + F.abs(F.col("lon") - lon)
    best = F.min_by(F.struct("y", "x", "wse"), F.struct(l1.alias("d"), "y", "x"))
    found = swath.groupBy(*by).agg(best.alias("s"), F.min("lat").alias("s0"), F.max("lat").alias("s1"), F.min("lon").alias("w0"), F.max("lon").alias("w1"))
    return found.where(F.lit(lat).between(F.col("s0"), F.col("s1")) & F.lit(lon).between(F.col("w0"), F.col("w1"))).select(*by, "s.*")


def best_tier(files: DataFrame, tiers: Sequence[str], path: str = "path", by: Sequence[str] = ("obs_date",)) -> DataFrame:
    """Of each date the files of the first tier that has any; a tier is a text that the path holds."""
    tier = F.lit(None).cast("int")
    for k in reversed(range(len(tiers))):
        tier = F.when(F.col(path).contains(tiers[k]), k).otherwise(tier)
    ranked = files.withColumn("tier", tier).where("tier is not null")
    return ranked.withColumn("_best", F.min("tier").over(W.partitionBy(*by))).where("tier = _best").drop("_best")


def unique_lakes(features: DataFrame, name: str = "lake_name", order: Sequence[str] = ("file_id", "lake_id")) -> DataFrame:
    """One feature per name, the first in order."""
    return features.groupBy(name).agg(F.min_by(F.struct(*features.columns), F.struct(*order)).alias("s")).select("s.*")


def common_name(series: DataFrame, name: str = "lake_name") -> DataFrame:
    """The most frequent name, the least on ties."""
    return series.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(1).select(name)


def of_zone(files: DataFrame, zone: str, path: str = "path") -> DataFrame:
    """Files whose name holds the UTM zone."""
    return files.where(F.regexp_extract(path, r"UTM(\d{1,2}[C-X])", 1) == zone)

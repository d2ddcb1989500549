"""Metrics of a month: areas by kind of water, bodies, fragmentation, centroid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CELL, CLOUD, HIGH_WATER, NODATA, PARTIAL, WATER, SeriesParams, ratio
from ..storage import stored
from .spatial import label_components, perimeters


def water_kinds(water_prob: Column, params: SeriesParams = SeriesParams()) -> dict[str, Column]:
    """Permanent, seasonal, ephemeral and any water; unlike the statistics' masks these don't overlap."""
    return {"permanent": water_prob >= params.permanent, "seasonal": (water_prob >= params.seasonal_min) & (water_prob < params.permanent), "ephemeral": (water_prob > 0) & (water_prob < params.seasonal_min), "any_water": water_prob > 0}


def month_areas(monthly: DataFrame, stats: DataFrame, pixel_km2: float, params: SeriesParams = SeriesParams(), keys: Sequence[str] = CELL, month: str = "month_key", cells: int | None = None) -> DataFrame:
    """Areas by kind of water, valid cells and cloud share of each month: of the rows that are there, or of a grid of `cells` cells."""
    kinds = water_kinds(F.coalesce("water_prob", F.lit(0.0)), params)
    c, wet = F.col("cls"), F.col("cls").isin(*WATER)
    x = monthly.join(stats.select(*keys, "water_prob"), list(keys), "left")
    area = lambda pred: F.count_if(pred) * pixel_km2
    return x.groupBy(month).agg(
        area(wet).alias("total_area_km2"), *(area(wet & kinds[k]).alias(f"{k}_area_km2") for k in ("permanent", "seasonal", "ephemeral")),
        area(c.isin(*HIGH_WATER)).alias("high_conf_area_km2"), area(c == PARTIAL).alias("partial_area_km2"),
        F.count_if(c != NODATA).alias("valid_pixels"), ratio(F.count_if(c == CLOUD), F.lit(cells) if cells else F.count("*")).alias("cloud_fraction"),
    )


def body_metrics(monthly: DataFrame, pixel_km2: float, grid: dict[str, float] | None = None, params: SeriesParams = SeriesParams(), keys: Sequence[str] = CELL, month: str = "month_key") -> DataFrame:
    """Number, sizes, fragmentation and centroid of each month's water bodies (4-connected, of a minimal size)."""
    r, c = keys
    g = grid or {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}
    monthly = stored(monthly.select(month, *keys, "cls"), "monthly")
    wet = monthly.where(F.col("cls").isin(*WATER)).select(month, *keys)
    labelled = label_components(wet, [month], keys)
    sizes = labelled.groupBy(month, "component").agg(F.count("*").alias("n"))
    valid = sizes.where(F.col("n") >= params.min_body_size).join(perimeters(labelled, [month], keys), [month, "component"], "left")
    bodies = valid.groupBy(month).agg(F.count("*").alias("num_water_bodies"), F.avg(F.col("n") * pixel_km2).alias("mean_body_size_km2"), F.max(F.col("n") * pixel_km2).alias("max_body_size_km2"), F.sum("perimeter").alias("_p"))
    whole = wet.groupBy(month).agg(F.count("*").alias("_n"), F.avg(r).alias("_r"), F.avg(c).alias("_c"))
    x = monthly.select(month).distinct().join(whole, month, "left").join(bodies, month, "left")
    some = F.col("num_water_bodies").isNotNull()
    zero = F.lit(0.0)
    return x.select(
        month, F.coalesce("num_water_bodies", F.lit(0)).alias("num_water_bodies"), F.coalesce("mean_body_size_km2", zero).alias("mean_body_size_km2"), F.coalesce("max_body_size_km2", zero).alias("max_body_size_km2"),
        F.when(some, F.col("_p") / (F.col("_n") + 1e-10)).otherwise(zero).alias("fragmentation_index"),
        F.when(some, g["a"] * F.col("_c") + g["b"] * F.col("_r") + g["c"]).otherwise(zero).alias("centroid_x"),
        F.when(some, g["d"] * F.col("_c") + g["e"] * F.col("_r") + g["f"]).otherwise(zero).alias("centroid_y"),
    )


def monthly_metrics(monthly: DataFrame, stats: DataFrame, pixel_km2: float, grid: dict[str, float] | None = None, params: SeriesParams = SeriesParams(), keys: Sequence[str] = CELL, month: str = "month_key", cells: int | None = None) -> DataFrame:
    """All metrics of each month, with its year and month."""
    monthly = stored(monthly.select(month, *keys, "cls"), "monthly")
    both = month_areas(monthly, stats, pixel_km2, params, keys, month, cells).join(body_metrics(monthly, pixel_km2, grid, params, keys, month), month)
    return both.withColumns({"year_i": F.floor(F.col(month) / 100).cast("int"), "month_i": (F.col(month) % 100).cast("int")})


def one_per_month(cleaned: DataFrame, raw: DataFrame, month: str = "month_key", dedupe: bool = True) -> DataFrame:
    """Cleaned and raw composites together; a month in both is taken from the cleaned ones unless dedupe is off."""
    more = raw.join(cleaned.select(month).distinct(), month, "left_anti") if dedupe else raw
    return cleaned.unionByName(more, allowMissingColumns=True)

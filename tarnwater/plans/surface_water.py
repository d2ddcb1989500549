"""Whole plans: from scenes to monthly metrics, and from a series to its trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import month_key
from ..model import CELL, INTR, CleanParams, MonthlyParams, Product, SeriesParams, StatisticsParams
from ..operators import catalog, clean, merge, metrics, monthly, series, statistics
from ..sources import geotiff
from ..storage import stored


def scenes_of_files(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float], DataFrame]:
    """(scenes, grid, rejects) of the GeoTIFF files below a path that have a date in their names.

    Scenes are (row_i, col_i, obs_date, file_pos, cls) of each file's first band, file_pos the path. Files of one
    reference system may differ in extent and resolution: all are put on the outermost bounds at the finest resolution.
    Files that can't be read are rejects (path, error); different reference systems are an error.
    """
    found = stored(geotiff.grids(spark, path), "grids")
    good = catalog.dated(found.where("error is null"))
    catalog.same(good)
    ends = good.agg(F.min("c"), F.max("f"), F.max(F.col("c") + F.col("width") * F.col("a")), F.min(F.col("f") + F.col("height") * F.col("e")), F.min("a"), F.min(-F.col("e"))).first()
    if ends[0] is None:
        raise ValueError(f"no readable files with a date and a grid at {path}")
    left, top, right, bottom, dx, dy = ends
    grid = {"width": round((right - left) / dx), "height": round((top - bottom) / dy), "a": dx, "c": left, "e": -dy, "f": top}
    cells, _ = geotiff.split(geotiff.cells(spark, path, "report"))
    cells = cells.where("band = 1").withColumn("cls", F.col("value").cast("int")).join(good.select("path", "obs_date", *"acef"), "path")
    cells = merge.onto(cells, {k: F.col(k) for k in "acef"}, grid)
    return cells.select("row_i", "col_i", "obs_date", F.col("path").alias("file_pos"), "cls"), grid, found.where("error is not null").select("path", "error")


def daily(scenes: DataFrame, product: Product = INTR, keys: Sequence[str] = CELL, order: str = "file_pos") -> DataFrame:
    """Daily mosaics of a product, with their month."""
    return merge.priority_merge(scenes, [*keys, "obs_date"], product, order).withColumn("month_key", month_key(F.col("obs_date")))


def with_inwam(intr: DataFrame, inwam: DataFrame | None, keys: Sequence[str] = CELL) -> DataFrame:
    """Daily classes with the second product beside them, null where it is missing."""
    if inwam is None:
        return intr.withColumn("inwam", F.lit(None).cast("int"))
    return intr.join(inwam.select(*keys, "obs_date", F.col("cls").alias("inwam")), [*keys, "obs_date"], "left")


def composites(obs: DataFrame, cells: int, keys: Sequence[str] = CELL, stats_params: StatisticsParams = StatisticsParams(), monthly_params: MonthlyParams = MonthlyParams(), clean_params: CleanParams = CleanParams()) -> tuple[DataFrame, DataFrame]:
    """(statistics, cleaned monthly composites) from daily observations (cls, inwam, obs_date, month_key) of a grid of `cells` cells.

    Readers leave out cells without data, so a date's shares need the grid's size.
    Statistics, passing observations and composites are each written once: later steps read them several times.
    """
    stats = stored(statistics.water_statistics(obs, stats_params, keys), "statistics")
    passed = monthly.passing(obs, monthly.daily_quality(obs, stats, monthly_params, keys, cells=cells))
    months = stored(monthly.monthly_vote(passed, stats, monthly_params, keys), "monthly")
    has_inwam = not obs.where(F.col("inwam") >= 0).isEmpty()
    return stats, stored(clean.clean_monthly(months, stats, clean_params, has_inwam, keys), "cleaned")


def series_of(cleaned: DataFrame, stats: DataFrame, pixel_km2: float, cells: int | None = None, grid: dict[str, float] | None = None, keys: Sequence[str] = CELL, params: SeriesParams = SeriesParams()) -> DataFrame:
    """Monthly metrics with anomalies of the total area."""
    rows = metrics.monthly_metrics(cleaned.select("month_key", *keys, "cls"), stats, pixel_km2, grid, params, keys, cells=cells)
    return series.anomalies(rows, "total_area_km2")


def trends(rows: DataFrame, metric: str = "total_area_km2", method: str = "both") -> dict[str, DataFrame]:
    """Linear fit and Mann-Kendall test with Sen's slope, as asked for: linear, mann-kendall or both."""
    out = {}
    if method in ("linear", "both"):
        out["linear"] = series.linear_trend(rows, metric)
    if method in ("mann-kendall", "both"):
        out["mann_kendall"], out["sen"] = series.mann_kendall(rows, metric), series.sens_slope(rows, metric)
    return out

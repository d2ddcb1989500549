"""Scene and granule catalogues: filters, grouping of assets, incremental selection, download choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import acquisition, slc_off


def split_slc_off(scenes: DataFrame, scene: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): without and with the scenes of satellite 7 after its scan-line corrector failed."""
    off = slc_off(F.col(scene))
    return scenes.where(~off), scenes.where(off)


def between_dates(rows: DataFrame, start: str | None = None, end: str | None = None, year: int | None = None, dates: Sequence[str] = (), day: str = "obs_date") -> DataFrame:
    """Date filters that reach the partitions of a table partitioned by `day`."""
    d = F.col(day)
    if start:
        rows = rows.where(d >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(d <= F.lit(end).cast("date"))
    if year:
        rows = rows.where((d >= F.lit(f"{year}-01-01").cast("date")) & (d <= F.lit(f"{year}-12-31").cast("date")))
    return rows.where(d.isin(*(F.lit(x).cast("date") for x in dates))) if dates else rows


def dated(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with the date in their name; those without go."""
    return files.withColumn("obs_date", acquisition(F.col(path))).where("obs_date is not null")


def layers(files: DataFrame, path: str = "path") -> DataFrame:
    """`layer` of product files by their suffix, and whether the granule has the leading layer."""
    layer = F.when(F.col(path).contains("_WTR-2."), "WTR-2").when(F.col(path).contains("_WTR."), "WTR").when(F.col(path).contains("_CONF."), "CONF")
    return files.withColumn("layer", layer).where("layer is not null")


def complete_groups(assets: DataFrame, key: str = "granule", asset: str = "layer", n: int = 3) -> DataFrame:
    """Keys that have n distinct assets."""
    return assets.groupBy(key).agg(F.count_distinct(asset).alias("n_assets")).where(F.col("n_assets") == n)


def dependent_layers(assets: DataFrame, key: str = "granule", asset: str = "layer", leading: str = "WTR") -> DataFrame:
    """Assets of granules that have the leading layer; the others are of no use without it."""
    return assets.join(assets.where(F.col(asset) == leading).select(key).distinct(), key, "left_semi")


def raster_links(links: DataFrame, key: str = "granule", url: str = "url", pos: str = "pos", grid: str = "100m") -> DataFrame:
    """(key, url): the first link of each granule to a NetCDF file of a grid, of equal places the lesser."""
    hits = links.where(F.col(url).contains(grid) & F.lower(url).endswith(".nc"))
    return hits.groupBy(key).agg(F.min(F.struct(pos, url))[url].alias(url))


def all_dates(*tables: DataFrame, day: str = "obs_date") -> DataFrame:
    """The distinct dates of any of the tables."""
    found = tables[0].select(day).distinct()
    for more in tables[1:]:
        found = found.union(more.select(day).distinct())
    return found.distinct()


def in_crs(grids: DataFrame, epsg: int = 4326) -> DataFrame:
    """Rasters of one reference system; others are skipped."""
    return grids.where(F.col("epsg") == epsg)


def same(grids: DataFrame, columns: Sequence[str] = ("epsg",)) -> None:
    """An error unless all rasters agree in the columns: the reference system, or with width, height, a, c, e, f the whole grid."""
    found = grids.select(*columns).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"rasters differ in {', '.join(columns)}: {found[0]} and {found[1]}")


def missing(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """What isn't there yet."""
    return wanted.join(present.select(*on).distinct(), list(on), "left_anti")


def clear_enough(items: DataFrame, most: float, names: Sequence[str] = ("CloudCover", "eo:cloud_cover")) -> DataFrame:
    """Items whose cloud cover, under the first name present, is within a limit."""
    known = [F.col(f"`{n}`").cast("double") for n in names if n in items.columns]
    return items.where(F.coalesce(*known) <= most) if known else items


def best_option(options: DataFrame, key: str = "scene_id", name: str = "product_name", order: str = "pos") -> DataFrame:
    """The first available download option with a preferred product name, else the first available."""
    low = F.lower(name)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.when(low.contains("dswe") | low.contains("level-3"), 0).otherwise(1), order))
    return options.where("available").withColumn("_k", rank).where("_k = 1").drop("_k")


def date_chunks(start: str, end: str, spark, pieces: int = 10) -> DataFrame:
    """A span of days cut into about `pieces` runs that touch without overlapping: (start, stop), both included."""
    span = spark.sql(f"select date '{start}' as a, date '{end}' as z")
    days = F.greatest(F.lit(1), F.floor(F.datediff("z", "a") / pieces)).cast("int")
    firsts = span.withColumn("_n", days).select("z", "_n", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("z", "a") / F.col("_n")).cast("int"))).alias("k"), "a")
    return firsts.select(F.expr("date_add(a, k * _n)").alias("start"), F.least(F.expr("date_add(a, (k + 1) * _n - 1)"), F.col("z")).alias("stop")).where("start <= stop")


def gaps(ranges: DataFrame) -> DataFrame:
    """Ranges that don't begin on the day after the one before ends, with the days between."""
    before = F.lag("stop").over(W.orderBy("start"))
    return ranges.withColumn("gap_days", F.datediff("start", before) - 1).where("gap_days <> 0")


def too_small(files: DataFrame, least: int = 1024, length: str = "length") -> DataFrame:
    """Files that are likely broken. They are listed, never deleted."""
    return files.where(F.col(length) < least)


def status_counts(outcomes: DataFrame, status: str = "status") -> DataFrame:
    return outcomes.groupBy(status).agg(F.count("*").alias("n"))


def addresses(tiles: DataFrame, template: str, **columns: str) -> DataFrame:
    """`url` from a template with %s in the order of the given columns."""
    return tiles.withColumn("url", F.format_string(template, *(F.col(c).cast("string") for c in columns.values())))


def known_datasets(datasets: DataFrame, words: Sequence[str], name: str = "dataset") -> DataFrame:
    """Datasets whose name holds one of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(name).contains(w.lower())
    return datasets.where(hit)

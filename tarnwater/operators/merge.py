"""Composites of overlapping scenes: one class per cell from many.

All are hash aggregates with partial aggregation before the shuffle. The order of scenes enters by an explicit column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NODATA, Product


def priority_merge(scenes: DataFrame, keys: Sequence[str], product: Product, order: str = "file_pos", value: str = "cls") -> DataFrame:
    """The most preferred listed class; else the first other value by `order`; else nodata.

    Two primitive aggregates carry it: the least rank among listed classes, and the first unlisted value.
    """
    listed = F.array(*(F.lit(c) for c in product.priority))
    rank = F.array_position(listed, F.col(value).cast("int")) if product.priority else F.lit(0)
    valid = F.col(value) != product.nodata
    best = F.min(F.when(valid & (rank > 0), rank)).alias("_rank")
    other = F.min_by(F.when(valid & (rank == 0), F.col(value)), F.when(valid & (rank == 0), F.col(order))).alias("_other")
    chosen = F.coalesce(F.try_element_at(listed, F.col("_rank").cast("int")) if product.priority else F.lit(None), F.col("_other"), F.lit(product.nodata))
    return scenes.groupBy(*keys).agg(best, other).select(*keys, chosen.cast("int").alias(value))


def priority_pick(scenes: DataFrame, keys: Sequence[str], product: Product, carry: Sequence[str], order: str = "file_pos", value: str = "cls") -> DataFrame:
    """The columns `carry` of the scene that wins the priority merge: least rank, then least `order` (below 2**48). Nodata comes last."""
    listed = F.array(*(F.lit(c) for c in product.priority))
    rank = F.array_position(listed, F.col(value).cast("int"))
    place = F.when(rank > 0, rank).when(F.col(value) != product.nodata, 1000).otherwise(2000).cast("long") * F.lit(1 << 48) + F.col(order)
    return scenes.groupBy(*keys).agg(*(F.min_by(c, place).alias(c) for c in carry))


def min_merge(scenes: DataFrame, keys: Sequence[str], nodata: int = NODATA, value: str = "cls") -> DataFrame:
    """The least class that isn't nodata; land wins over water by its code."""
    return scenes.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(value) != nodata, F.col(value))), F.lit(nodata)).cast("int").alias(value))


def min_positive_merge(scenes: DataFrame, keys: Sequence[str], order: str = "file_pos", value: str = "cls", stamp: str = "acq_min") -> DataFrame:
    """Fold in file order: a later value replaces the present one if it is positive and less; with the time of the file it is from.

    A first value of 0 stays. Otherwise the result is the least of the first value and all positive later ones, the earliest on ties.
    Scenes are reduced by value first; both steps are hash aggregates on plain numbers.
    """
    by_value = scenes.groupBy(*keys, value).agg(F.min(order).alias("_o"), F.min_by(stamp, order).alias("_t"))
    positive = F.when(F.col(value) > 0, F.col(value))
    both = by_value.groupBy(*keys).agg(F.min_by(value, "_o").alias("_v"), F.min_by("_t", "_o").alias("_s"), F.min(positive).alias("_p"), F.min_by("_t", positive).alias("_q"))
    use = (F.col("_v") != 0) & (F.col("_p") < F.col("_v"))
    return both.select(*keys, F.when(use, F.col("_p")).otherwise(F.col("_v")).cast("int").alias(value), F.when(use, F.col("_q")).otherwise(F.col("_s")).cast("int").alias(stamp))


def extent_union(extents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outer bounds and finest resolution of rasters (xmin, ymin, xmax, ymax, res)."""
    return extents.groupBy(*keys).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("res").alias("res"))


def difference(later: DataFrame, earlier: DataFrame, keys: Sequence[str], nodata: int = NODATA, value: str = "cls") -> DataFrame:
    """later - earlier where both cover a cell with data."""
    a, b = later.select(*keys, F.col(value).alias("_a")), earlier.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys)).where((F.col("_a") != nodata) & (F.col("_b") != nodata)).select(*keys, (F.col("_a") - F.col("_b")).alias("change"))


def common_grid(one: dict[str, float], two: dict[str, float]) -> dict[str, float]:
    """The intersection of two grids (width, height, a, c, e, f) at the finer resolution."""
    ends = [(g["c"], g["f"] + g["height"] * g["e"], g["c"] + g["width"] * g["a"], g["f"]) for g in (one, two)]
    left, bottom = (max(e[k] for e in ends) for k in (0, 1))
    right, top = (min(e[k] for e in ends) for k in (2, 3))
    if left >= right or bottom >= top:
        raise ValueError("the rasters don't overlap")
    width = round((right - left) / min(one["a"], two["a"]))
    height = round((top - bottom) / min(-one["e"], -two["e"]))
    return {"width": width, "height": height, "a": (right - left) / width, "c": left, "e": (bottom - top) / height, "f": top}


def onto(cells: DataFrame, grid: dict, target: dict[str, float]) -> DataFrame:
    """Cells (row_i, col_i, ...) of a grid on a target grid, each target cell with the value at its centre. No shuffle: a cell lists the centres inside it. `grid` may hold columns."""

    def inside(index: str, first: str, step: str, size: str):
        ratio, start = F.lit(grid[step] / target[step]), F.lit((grid[first] - target[first]) / target[step])
        edge = lambda k: F.ceil(start + k * ratio - 0.5)
        low, high = F.greatest(F.lit(0), edge(F.col(index))), F.least(F.lit(target[size] - 1), edge(F.col(index) + 1) - 1)
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    wide = cells.withColumns({"row_i": inside("row_i", "f", "e", "height"), "col_i": inside("col_i", "c", "a", "width")})
    return wide.withColumn("row_i", F.explode("row_i")).withColumn("col_i", F.explode("col_i"))


def aligned_difference(later: DataFrame, earlier: DataFrame, grid_later: dict[str, float], grid_earlier: dict[str, float], value: str = "value") -> DataFrame:
    """(row_i, col_i, change): later - earlier on their common grid."""
    target = common_grid(grid_later, grid_earlier)
    a, b = (onto(rows.select("row_i", "col_i", F.col(value).alias(name)), grid, target) for rows, grid, name in ((later, grid_later, "_a"), (earlier, grid_earlier, "_b")))
    return a.join(b, ["row_i", "col_i"]).select("row_i", "col_i", (F.col("_a") - F.col("_b")).alias("change"))

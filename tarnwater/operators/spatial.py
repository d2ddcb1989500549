"""Operators on the plane: connected components, perimeters, dilation, distances, resampling, polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CELL
from ..storage import stored
from .graph import components

#: Cells per side of the tiles in which components are labelled before tiles are joined.
TILE = 512
SHIFT = 21


def label_tile(rows: np.ndarray, cols: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each of the given cells the least position (in row-major order) of its component: labels sink along neighbours and are shortcut."""
    r0, c0 = rows.min(), cols.min()
    height, width = rows.max() - r0 + 3, cols.max() - c0 + 3
    at = (rows - r0 + 1) * width + cols - c0 + 1
    none = height * width
    label = np.full(none + 1, none, np.int64)
    label[at] = at
    steps = [1, width] + ([width + 1, width - 1] if diagonal else [])
    while True:
        was = label[at].copy()
        best = was
        for s in steps:
            best = np.minimum(best, np.minimum(label[at + s], label[at - s]))
        np.minimum.at(label, was, best)
        label[at] = np.minimum(label[at], best)
        label[at] = label[label[at]]
        if (label[at] == was).all():
            return label[at]


def _node(month: Sequence[str], r: Column, c: Column) -> Column:
    """One integer for a cell of a raster: rows and columns below two million, the raster's number (below two million) in front."""
    raster = F.col(month[0]).cast("long") if month else F.lit(0)
    return F.shiftleft(raster, 2 * SHIFT).bitwiseOR(F.shiftleft(r.cast("long"), SHIFT)).bitwiseOR(c.cast("long"))


def spread(cells: DataFrame, kept: Sequence[str], offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = CELL) -> DataFrame:
    """A row for each cell and offset (rows, columns, value): the cell moved, and `v`. The offsets are one constant."""
    r, c = keys
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("v")) for i, j, v in offsets))
    moved = cells.select(*kept, *keys, F.explode(listed).alias("_o"))
    return moved.select(*kept, (F.col(r) + F.col("_o.i")).cast("int").alias(r), (F.col(c) + F.col("_o.j")).cast("int").alias(c), F.col("_o.v").alias("v"))


def label_components(cells: DataFrame, raster: Sequence[str], keys: Sequence[str] = CELL, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(raster, cell, component) for the given cells of each raster; 4- or 8-connected, `raster` at most one integer column.

    Tiles are labelled by themselves, so a task holds one tile; cells on tile borders link the labels of neighbouring tiles, and the
    links' connected components join them. A component is named by its least cell.
    """
    r, c = keys
    group = [*raster, "_tr", "_tc"]
    tiled = cells.select(*raster, *keys, F.floor(F.col(r) / tile).cast("int").alias("_tr"), F.floor(F.col(c) / tile).cast("int").alias("_tc"))

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = frame[r].to_numpy(np.int64), frame[c].to_numpy(np.int64)
        found = label_tile(rows, cols, diagonal)
        width = cols.max() - cols.min() + 3
        frame["_lr"] = found // width - 1 + rows.min()
        frame["_lc"] = found % width - 1 + cols.min()
        return frame

    schema = T.StructType([*tiled.schema.fields, T.StructField("_lr", T.LongType()), T.StructField("_lc", T.LongType())])
    labelled = stored(tiled.groupBy(*group).applyInPandas(label, schema).select(*raster, *keys, _node(raster, F.col("_lr"), F.col("_lc")).alias("_label")), "labels")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    edge = F.lit(False)
    for column in keys:
        edge = edge | (F.pmod(F.col(column), F.lit(tile)).isin(0, tile - 1))
    border = labelled.where(edge)
    tile_of = lambda column: F.floor(F.col(column) / tile).cast("int")
    named = border.select(*raster, *keys, F.col("_label").alias("a"), tile_of(r).alias("_tr"), tile_of(c).alias("_tc"))
    moved = spread(named, [*raster, "a", "_tr", "_tc"], [(i, j, 0) for i, j in steps], keys).where((tile_of(r) != F.col("_tr")) | (tile_of(c) != F.col("_tc")))
    links = moved.join(border.withColumnRenamed("_label", "b"), [*raster, *keys]).where("a <> b").select("a", "b").distinct()
    if links.isEmpty():  # rasters of one tile
        return labelled.withColumnRenamed("_label", "component")
    joined = components(links)
    return labelled.join(joined, labelled["_label"] == joined["node"], "left").select(*raster, *keys, F.coalesce("component", "_label").alias("component"))


def perimeters(labelled: DataFrame, raster: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """(raster, component, perimeter) by the estimator of Benkrid and Crookes: border cells weigh by how their border neighbours lie.

    Each cell tells its four neighbours that it is there, border cells then tell their eight neighbours; both are sums by cell.
    """
    each = [*raster, "component", *keys]

    def told(rows: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
        return spread(rows, [*raster, "component"], steps, keys).groupBy(*each).agg(F.sum("v").alias("v"))

    cross = [(0, 0, 100), (0, 1, 1), (1, 0, 1), (0, -1, 1), (-1, 0, 1)]
    border = told(labelled, cross).where("v >= 100 and v < 104")
    ring = [(0, 0, 1), *((i, j, 2 if i * j == 0 else 10) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)]
    codes = told(border, ring).where("v % 2 = 1")
    # The published weights of the neighbourhood codes.
    weights = dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0) | dict.fromkeys((21, 33), math.sqrt(2)) | dict.fromkeys((13, 23), (1 + math.sqrt(2)) / 2)
    weight = F.element_at(F.array(*(F.lit(weights.get(v, 0.0)) for v in range(50))), F.col("v").cast("int") + 1)
    return codes.groupBy(*raster, "component").agg(F.sum(weight).alias("perimeter"))


def _offsets(steps: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps]


def dilate(cells: DataFrame, raster: Sequence[str], keys: Sequence[str] = CELL, steps: int = 1) -> DataFrame:
    """The cells grown by a cross `steps` times, distinct. May leave the grid; join with it to cut."""
    return spread(cells, raster, [(i, j, 0) for i, j in _offsets(steps)], keys).drop("v").distinct()


def land_beside_water(grid: DataFrame, raster: Sequence[str], keys: Sequence[str] = CELL, state: str = "state", cloud_steps: int = 7) -> DataFrame:
    """Land cells (0) with a water cell (1) on one of four sides and no other cell (neither) within `cloud_steps`."""
    near = dilate(grid.where(F.col(state) == 1), raster, keys)
    doubt = dilate(grid.where(~F.col(state).isin(0, 1)), raster, keys, cloud_steps)
    return grid.where(F.col(state) == 0).select(*raster, *keys).join(near, [*raster, *keys], "left_semi").join(doubt, [*raster, *keys], "left_anti")


def remove_small(cells: DataFrame, raster: Sequence[str], keys: Sequence[str], least: Column | float) -> DataFrame:
    """The cells whose 4-connected component has at least `least` cells."""
    labelled = label_components(cells.select(*raster, *keys), raster, keys)
    large = labelled.groupBy(*raster, "component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return labelled.join(large, [*raster, "component"], "left_semi").select(*raster, *keys)


def resample_nearest(source: DataFrame, target: DataFrame, to: dict[str, float], of: dict[str, float], keys: Sequence[str] = CELL) -> DataFrame:
    """Values of `source` on the cells of `target`, by the cell in which each target centre lies. Grids a..f of one CRS, unrotated."""
    r, c = keys
    x = to["a"] * (F.col(c) + 0.5) + to["c"]
    y = to["e"] * (F.col(r) + 0.5) + to["f"]
    looked = target.withColumns({"_r": F.floor((y - of["f"]) / of["e"]).cast("int"), "_c": F.floor((x - of["c"]) / of["a"]).cast("int")})
    values = source.withColumnsRenamed({r: "_r", c: "_c"})
    return looked.join(values, ["_r", "_c"], "left").drop("_r", "_c")


def zoom_index(index: Column, size: int, other: int) -> Column:
    """Where a cell index of a grid of `size` falls in one of `other` when corner cells are matched to corner cells."""
    return F.rint(index * ((other - 1) / (size - 1) if size > 1 else 0.0)).cast("int")


def bilinear(source: DataFrame, points: DataFrame, value: str, x: str = "x", y: str = "y", keys: Sequence[str] = CELL) -> DataFrame:
    """`value` at fractional positions (x columns, y rows) from the four cells around; weights of missing cells are shared out."""
    r, c = keys
    at = points.withColumn("_id", F.xxhash64(*points.columns))
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    spread = at.select("*", F.explode(F.array(*(F.struct((F.floor(y) + i).cast("int").alias(r), (F.floor(x) + j).cast("int").alias(c), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i, j in corners))).alias("s")).select(*points.columns, "s.*")
    summed = spread.join(source.select(*keys, value), list(keys)).where(F.col(value).isNotNull())
    return summed.groupBy(*points.columns).agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias(value))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct<x, y>), by counting crossings to its right."""
    n = F.size(ring)
    crossing = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(
            (F.get(ring, i)["y"] > y) != (F.get(ring, (i + 1) % n)["y"] > y),
            (x < (F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"]) * (y - F.get(ring, i)["y"]) / F.nullif(F.get(ring, (i + 1) % n)["y"] - F.get(ring, i)["y"], F.lit(0.0)) + F.get(ring, i)["x"]).cast("int"),
        ).otherwise(0),
    )
    return F.when(n < 3, False).otherwise(F.aggregate(crossing, F.lit(0), lambda a, v: a + v) % 2 == 1)


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from a ring, 0 inside."""
    n = F.size(ring)

    def side(i: Column) -> Column:
        ax, ay, bx, by = F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(ring, (i + 1) % n)["x"], F.get(ring, (i + 1) % n)["y"]
        t = F.coalesce(F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    return F.when(inside(x, y, ring), 0.0).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), n - 1), side)))


def rasterize(grid: DataFrame, polygons: DataFrame, ring: str = "ring", keys: Sequence[str] = CELL) -> DataFrame:
    """Grid cells (unit squares in grid coordinates) that a polygon touches.

    A polygon is dealt to the 64-cell blocks its bounds meet, and cells of the same block are tested: an equi-join, not a product.
    A cell is touched if its centre is inside or a side meets its square.
    """
    r, c = keys
    block = 64
    bound = lambda f, k: F.floor(f(F.transform(F.col(ring), lambda p: p[k])) / block).cast("int")
    dealt = polygons.select(F.col(ring), F.explode(F.sequence(bound(F.array_min, "y"), bound(F.array_max, "y"))).alias("_br"), bound(F.array_min, "x").alias("_x0"), bound(F.array_max, "x").alias("_x1"))
    dealt = dealt.select(ring, "_br", F.explode(F.sequence("_x0", "_x1")).alias("_bc"))
    cells = grid.select(*keys, F.floor(F.col(r) / block).cast("int").alias("_br"), F.floor(F.col(c) / block).cast("int").alias("_bc"))
    touched = inside(F.col(c) + 0.5, F.col(r) + 0.5, F.col(ring)) | sides_meet_square(F.col(c), F.col(r), F.col(ring))
    return cells.join(dealt, ["_br", "_bc"]).where(touched).select(*keys).distinct()


def sides_meet_square(x: Column, y: Column, ring: Column) -> Column:
    """Whether a side of the ring meets the unit square from (x, y): the stretch of the side within the square's columns and within its rows overlap."""
    n = F.size(ring)

    def stretch(a: Column, b: Column, low: Column) -> tuple[Column, Column]:
        level = a == b
        one, two = F.try_divide(low - a, b - a), F.try_divide(low + 1 - a, b - a)
        return F.when(level, F.when(a.between(low, low + 1), 0.0).otherwise(2.0)).otherwise(F.least(one, two)), F.when(level, 1.0).otherwise(F.greatest(one, two))

    def meets(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        (from_x, to_x), (from_y, to_y) = stretch(p["x"], q["x"], x), stretch(p["y"], q["y"], y)
        return F.greatest(F.lit(0.0), from_x, from_y) <= F.least(F.lit(1.0), to_x, to_y)

    return F.exists(F.transform(F.sequence(F.lit(0), n - 1), meets), lambda hit: hit)


def crop(cells: DataFrame, lon: Column, lat: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose (lon, lat) lie in (west, south, east, north)."""
    return cells.where(lon.between(box[0], box[2]) & lat.between(box[1], box[3]))


def boxes_meet(xmin: Column, ymin: Column, xmax: Column, ymax: Column, box: tuple[float, float, float, float]) -> Column:
    return (xmin <= box[2]) & (xmax >= box[0]) & (ymin <= box[3]) & (ymax >= box[1])

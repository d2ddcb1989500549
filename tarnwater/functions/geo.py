"""Coordinates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = 111320.0


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number and band letter; latitudes beyond the bands take the outermost one."""
    band = F.greatest(F.lit(1), F.least(F.lit(20), F.floor((lat + 80) / 8) + 1)).cast("int")
    return F.concat((F.floor((lon + 180) / 6) + 1).cast("int").cast("string"), F.substring(F.lit("CDEFGHJKLMNPQRSTUVWX"), band, F.lit(1)))


def mercator(lon: Column, lat: Column) -> Column:
    import math

    return F.struct((EARTH_RADIUS * F.radians(lon)).alias("x"), (EARTH_RADIUS * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"))


def degrees_per_pixel(metres: Column, lat: Column) -> Column:
    """A resolution in metres as degrees of longitude and latitude at a latitude."""
    return F.struct((metres / (METRES_PER_DEGREE * F.cos(F.radians(lat)))).alias("lon"), (metres / METRES_PER_DEGREE).alias("lat"))


def pixel_to_geo(row: Column, col: Column, grid: dict[str, float]) -> Column:
    return F.struct((grid["a"] * col + grid["b"] * row + grid["c"]).alias("x"), (grid["d"] * col + grid["e"] * row + grid["f"]).alias("y"))


def geo_to_pixel(x: Column, y: Column, grid: dict[str, float]) -> Column:
    return F.struct(F.floor((y - grid["f"]) / grid["e"]).cast("int").alias("row"), F.floor((x - grid["c"]) / grid["a"]).cast("int").alias("col"))


def pixel_area_km2(grid: dict[str, float]) -> float:
    return abs(grid["a"] * grid["e"]) / 1e6


def wkt_ring(wkt: Column) -> Column:
    """The first ring of a WKT polygon as array<struct<x, y>>."""
    body = F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))


def ring_bounds(ring: Column, digits: int | None = None) -> Column:
    """West, south, east, north of a ring; with digits, rounded outwards."""
    def axis_of(axis: str) -> Column:
        return F.transform(ring, lambda p: p[axis])

    out = {}
    for name, pick, axis, turn in (("west", F.array_min, "x", F.floor), ("south", F.array_min, "y", F.floor), ("east", F.array_max, "x", F.ceil), ("north", F.array_max, "y", F.ceil)):
        value = pick(axis_of(axis))
        out[name] = value if digits is None else turn(value * 10.0**digits) / 10.0**digits
    return F.struct(*(v.alias(k) for k, v in out.items()))

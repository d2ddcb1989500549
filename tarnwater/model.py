"""Data model: class codes, products, parameters, and the codec between sentinels and nulls.

A raster is a long table with a row per cell and date: `row_i`, `col_i`, `obs_date`, `month_key` (yyyymm), `cls`, and further layers as
columns. Cells are the columns named in CELL; tables of one grid share them, so overlays are equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = ("row_i", "col_i")

OBSERVATIONS = T.StructType([T.StructField("product", T.StringType()), T.StructField("obs_date", T.DateType()), T.StructField("row_i", T.IntegerType()), T.StructField("col_i", T.IntegerType()), T.StructField("cls", T.ShortType())])
GRID = T.StructType([T.StructField("grid_id", T.StringType()), T.StructField("crs", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in "abcdef"), T.StructField("nodata", T.ShortType())])

# Class codes of the two product families and of the cleaner's confidence layer.
LAND, WATER, HIGH_WATER, PARTIAL, CLOUD, NODATA = 0, (1, 2, 3, 4), (1, 2), 3, 9, 255
OPERA_LAND, OPERA_WATER, OPERA_PARTIAL, OPERA_SNOW, OPERA_CLOUD, OPERA_OCEAN, OPERA_VALID_BELOW = 0, 1, 2, 252, 253, 254, 250
CONFIDENCE = {"unchanged": 0, "ocean": 1, "persistent_water": 2, "stable_land": 3, "temporal_fill": 4, "fallback_mode": 5}


@dataclass(frozen=True)
class Product:
    """A layer and how overlapping scenes of it merge: classes in order of preference."""

    key: str
    priority: tuple[int, ...]
    nodata: int = NODATA


INTR = Product("INTR", (1, 2, 3, 4, 0, 9))
INWAM = Product("INWAM", (1, 2, 3, 4, 0, 9))
DSWX = Product("WTR", (1, 0, 2))


@dataclass(frozen=True)
class StatisticsParams:
    water: tuple[int, ...] = WATER
    cloud: int = 4
    nodata: int = NODATA
    persistent: float = 0.81
    ephemeral_min: float = 0.1
    stable_land_max: float = 0.4
    ocean: float = 0.6
    shore_buffer_km: float = 3.0


@dataclass(frozen=True)
class MonthlyParams:
    max_daily_cloud: float = 0.6
    min_daily_valid: float = 0.2
    min_daily_water: float = 0.0
    water_prob: float = 0.55
    max_stats_mismatch: float = 0.3
    water_fraction: float = 0.6
    partial_fraction: float = 0.3


@dataclass(frozen=True)
class CleanParams:
    max_fill_months: int = 3
    min_water_pixels: int = 9
    calendar_offsets: bool = False


@dataclass(frozen=True)
class SeriesParams:
    permanent: float = 0.8
    seasonal_min: float = 0.15
    min_body_size: int = 10
    seasonal_period: int = 12


def decode(cls: Column, nodata: int = NODATA) -> Column:
    """Sentinel to null."""
    return F.nullif(cls, F.lit(nodata))


def encode(cls: Column, nodata: int = NODATA) -> Column:
    """Null to sentinel."""
    return F.coalesce(cls, F.lit(nodata))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

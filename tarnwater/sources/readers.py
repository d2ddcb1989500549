"""Readers: partitioned observation tables, CSV series, catalogues in JSON. Schemas are given, never inferred where rows decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import OBSERVATIONS


def observations(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, product: str | None = None) -> DataFrame:
    """Observations partitioned by obs_date (and product); the date filter prunes partitions."""
    rows = spark.read.schema(OBSERVATIONS).parquet(path)
    if start:
        rows = rows.where(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("obs_date") <= F.lit(end).cast("date"))
    return rows.where(F.col("product") == product) if product else rows


def statistics(spark: SparkSession, path: str, required: Sequence[str] = ("water_prob", "mode_class", "persistent", "stable_land")) -> DataFrame:
    """A statistics table; missing columns are an error."""
    rows = spark.read.parquet(path)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"statistics at {path} lack {', '.join(lacking)}")
    return rows


def parsed_day(text: Column) -> Column:
    """yyyy-MM-dd or yyyyMM as a date; anything else is null."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(day, F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd"))).cast("date")


def _numeric(rows: DataFrame, columns: Sequence[str]) -> str:
    """The first of the columns whose values are numbers wherever they are set."""
    ok = rows.agg(*(F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()).alias(c) for c in columns)).first()
    for c in columns:
        if ok[c]:
            return c
    raise ValueError("no numeric column")


def index_series(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A climate index, GRACE or GNSS series (month_key, day, value): the date is `date`, `datetime` or the first column, the value the named or first numeric one."""
    raw = spark.read.option("header", True).csv(path)
    day = next((c for c in ("date", "datetime") if c in raw.columns), raw.columns[0])
    value = column or _numeric(raw, [c for c in raw.columns if c != day])
    out = raw.select(parsed_day(F.substring(F.col(f"`{day}`"), 1, 10)).alias("day"), F.col(f"`{value}`").try_cast("double").alias("value"))
    return out.select((F.year("day") * 100 + F.month("day")).alias("month_key"), "day", "value")


def water_series(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """One metric of a written series; an unknown one is an error that names the others."""
    raw = spark.read.option("header", True).csv(path)
    if metric not in raw.columns:
        raise ValueError(f"{metric} isn't in the series; it has {[c for c in raw.columns if 'area' in c or 'anomaly' in c]}")
    return raw.select(F.to_timestamp("datetime").alias("datetime"), F.col(metric).try_cast("double").alias("water_metric"))


def gauge(spark: SparkSession, path: str, offset: float = 0.0) -> DataFrame:
    """A gauge table with DATE and RES ELE FEET as (day, level) in metres."""
    from ..functions.names import gauge_metres

    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.to_date("DATE").alias("day"), gauge_metres(F.col("`RES ELE FEET`"), offset).alias("level"))


def catalogue_csv(spark: SparkSession, path: str, names: dict[str, Sequence[str]], encodings: Sequence[str] = ("UTF-8", "windows-1252", "ISO-8859-1")) -> DataFrame:
    """Columns under any of several header names, in the first encoding that reads without replacement characters."""
    raw = None
    for encoding in encodings:
        raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
        bad = F.lit(False)
        for c in raw.columns:
            bad = bad | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
        if not any("�" in c for c in raw.columns) and raw.where(bad).isEmpty():
            break
    plain = {c.lstrip("﻿").strip(): c for c in raw.columns}
    pick = lambda options: F.coalesce(*(F.col(f"`{plain[o]}`") for o in options if o in plain), F.lit(None).cast("string"))
    return raw.select(*(pick(v).alias(k) for k, v in names.items()))


FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a feature collection as (ring, properties); of several rings the outer one."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), T.ArrayType(FEATURE))).alias("f")).select("f.*")
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = listed.select(F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(F.array(one)).alias("p"), "properties").select(F.explode("p").alias("p"), "properties")
    return polygons.select(F.transform(F.col("p")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"), "properties")


def polygon_text(spark: SparkSession, path: str) -> DataFrame:
    """The polygon of a WKT file as (ring)."""
    from ..functions.geo import wkt_ring

    return spark.read.text(path, wholetext=True).select(wkt_ring(F.col("value")).alias("ring"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files below a folder. Contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"))

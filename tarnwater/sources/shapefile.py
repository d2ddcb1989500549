"""Shapefiles as tables: geometry from the .shp, attributes from the .dbf beside it, through Spark's own file access."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ROWS = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("rings", pa.list_(pa.list_(POINT))), ("attributes", pa.map_(pa.string(), pa.string()))])
SCHEMA = "path string, pos int, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>"


def geometries(data: bytes) -> Iterator[list | None]:
    """The parts of each record: rings of polygons, lines, single points. Heights and measures are left out; an empty record is null."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 0:
            yield None
        elif kind == 1:
            x, y = struct.unpack("<2d", body[4:20])
            yield [[{"x": x, "y": y}]]
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            yield [[{"x": flat[2 * k], "y": flat[2 * k + 1]} for k in range(a, b)] for a, b in zip(starts, starts[1:])]
        else:
            raise ValueError(f"shapes of kind {kind} aren't supported")


def records(data: bytes) -> Iterator[dict[str, str | None]]:
    """The attributes of each record as text, in the order of the file; blank ones are null."""
    n, header, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    for k in range(n):
        row, at = {}, header + k * size + 1
        for name, width in fields:
            raw = data[at : at + width].strip(b" \0")
            at += width
            try:
                row[name] = raw.decode() or None
            except UnicodeDecodeError:
                row[name] = raw.decode("latin-1")
        yield row


def features(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, rings, attributes) of each feature of the shapefiles below a path. A task holds one file."""

    def of(kind: str) -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(path)
        return raw.select(F.expr("left(path, length(path) - 4)").alias("stem"), F.col("content").alias(kind), F.col("path").alias(f"{kind}_path"))

    def run(batches):
        for batch in batches:
            for name, shp, dbf in zip(batch.column("shp_path"), batch.column("shp"), batch.column("dbf")):
                both = zip(geometries(shp.as_py()), records(dbf.as_py()))
                rows = [{"path": name.as_py(), "pos": k, "rings": g, "attributes": list(r.items())} for k, (g, r) in enumerate(both)]
                for first in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[first : first + 1000], ROWS)

    return of("shp").join(of("dbf"), "stem").select("shp_path", "shp", "dbf").mapInArrow(run, SCHEMA)


def lake_polygons(rows: DataFrame) -> DataFrame:
    """(lake_name, rings) of the files that have that attribute; of others nothing."""
    return rows.where(F.map_contains_key("attributes", F.lit("lake_name"))).select(F.col("attributes")["lake_name"].alias("lake_name"), "rings")


def named(rows: DataFrame) -> DataFrame:
    """Features with a lake_name: the attribute, else the first attribute with "name" in its own name, else Lake_<position>."""
    others = F.filter(F.map_keys("attributes"), lambda k: F.lower(k).contains("name"))
    has = F.map_contains_key("attributes", F.lit("lake_name"))
    other: Column = F.when(F.size(others) > 0, F.element_at("attributes", F.get(others, F.lit(0)))).otherwise(F.concat(F.lit("Lake_"), F.col("pos")))
    return rows.withColumn("lake_name", F.when(has, F.col("attributes")["lake_name"]).otherwise(other))


def first_level(rows: DataFrame, name: str, value: str = "wse") -> DataFrame:
    """(path, value): of each file the first feature whose lake_name holds the name, in any case."""
    hits = rows.where(F.lower(F.col("attributes")["lake_name"]).contains(name.lower()))
    return hits.groupBy("path").agg(F.min_by(F.col("attributes")[value].try_cast("double"), "pos").alias(value))

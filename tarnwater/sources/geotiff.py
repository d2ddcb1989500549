"""GeoTIFF files as tables and back.

`cells` reads them through Spark's own file access (any store), spark.read.format("geotiff") from local or mounted folders; a task takes
whole files. Strips and tiles, uncompressed, deflated or LZW, with predictors 2 and 3, of any number of bands of 8- to 64-bit numbers are
read. Each cell is a row (path, band, row_i, col_i, value, error); cells equal to the file's nodata value are left out. A file that can't
be read ends the job, or with errors="report" gives one row that has only its path and the error.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tags(data: bytes) -> tuple[str, dict[int, list]]:
    """Byte order and the first directory's entries."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = SIZES.get(kind, 1) * n
        here = at + 10 + 12 * k
        if size > 4:
            here = struct.unpack(order + "I", data[here : here + 4])[0]
        raw = data[here : here + size]
        found[tag] = [raw.split(b"\0")[0].decode("ascii", "replace")] if kind == 2 else list(struct.unpack(order + CODES[kind] * n, raw)) if kind in CODES else []
    return order, found


def unlzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, widened one code early."""
    clear, end = 256, 257
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, n, last, out = list(first), 9, 0, 0, None, []
    for byte in raw:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = list(first), 9, None
            continue
        if code > len(table) or (last is None and code >= len(table)):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


UNPACK = {1: lambda raw: raw, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}


def unpredicted(block: np.ndarray, kind: np.dtype, predictor: int) -> np.ndarray:
    """A block (rows, columns, samples) of `kind` from its bytes (rows, bytes) with differences undone."""
    rows, samples = block.shape[0], block.shape[2]
    if predictor == 2:
        return np.cumsum(block.view(kind), axis=1, dtype=kind.newbyteorder("="))
    if predictor == 3:
        planes = np.cumsum(block.view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, -1, samples)
    if predictor != 1:
        raise ValueError(f"unknown predictor {predictor}")
    return block


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """The bands as an array (band, row, column), and the grid: width, height, nodata; the affine a, c, e, f and epsg if the file has them."""
    order, t = tags(data)
    width, height, samples = t[256][0], t[257][0], t.get(277, [1])[0]
    pack, predictor, planar = (t.get(k, [1])[0] for k in (259, 317, 284))
    if pack not in UNPACK:
        raise ValueError(f"compression {pack} isn't supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[t.get(339, [1])[0]] + str(t[258][0] // 8))
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, [height])[0], height))
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    out = np.zeros((samples, height, width), kind.newbyteorder("="))
    across, down = -(-width // tw), -(-height // th)
    inside = samples if planar == 1 else 1
    for k, (start, size) in enumerate(zip(starts, sizes)):
        if start + size > len(data):
            raise ValueError("the file is cut off")
        band, at = divmod(k, across * down)
        block = np.frombuffer(UNPACK[pack](data[start : start + size]), kind)
        block = block[: len(block) // (tw * inside) * tw * inside].reshape(-1, tw, inside)
        block = unpredicted(block, kind, predictor)
        r, c = at // across * th, at % across * tw
        block = block[: height - r, : width - c].transpose(2, 0, 1)
        out[band : band + inside, r : r + block.shape[1], c : c + block.shape[2]] = block
    grid = {"width": width, "height": height, "nodata": float(t[42113][0]) if t.get(42113) else None}
    if 33550 in t and 33922 in t:
        (sx, sy, *_), (i, j, _, x, y, *_) = t[33550], t[33922]
        grid |= {"a": sx, "c": x - i * sx, "e": -sy, "f": y + j * sy}
    listed = t.get(34735, [])
    keys = {listed[k]: listed[k + 3] for k in range(4, len(listed) - 3, 4) if listed[k + 1] == 0}
    if code := keys.get(3072) or keys.get(2048):
        grid["epsg"] = code
    return out, grid


def encode(band: np.ndarray, grid: dict | None = None) -> bytes:
    """A deflated single-strip file of a band (row, column), or of several (band, row, column) side by side."""
    bands = band[None] if band.ndim == 2 else band
    grid, raw = grid or {}, zlib.compress(np.ascontiguousarray(bands.transpose(1, 2, 0)).tobytes())
    samples, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[band.dtype.kind]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [band.dtype.itemsize * 8] * samples), (259, 3, [8]), (262, 3, [1]), (273, 4, [0]), (277, 3, [samples]), (278, 4, [height]), (279, 4, [len(raw)]), (339, 3, [kind] * samples)]
    if "a" in grid:
        entries += [(33550, 12, [grid["a"], -grid["e"], 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid["c"], grid["f"], 0.0])]
    if grid.get("epsg"):
        # fixed values: model type (1 projected, 2 geographic) and the code under the key of its type; degrees have codes from 4000 to 4999
        model, key = (2, 2048) if 4000 <= grid["epsg"] < 5000 else (1, 3072)
        entries.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, model, key, 0, 1, grid["epsg"]]))
    if grid.get("nodata") is not None:
        entries.append((42113, 2, (f"{grid['nodata']:g}" + "\0").encode()))
    end = 8 + 2 + 12 * len(entries) + 4
    body, listed = b"", b""
    for tag, k, values in entries:
        packed = values if k == 2 else struct.pack("<" + CODES[k] * len(values), *values)
        if len(packed) > 4:
            listed += struct.pack("<HHII", tag, k, len(values), end + len(body))
            body += packed + b"\0" * (len(packed) % 2)
        else:
            listed += struct.pack("<HHI", tag, k, len(values)) + packed.ljust(4, b"\0")
    at = end + len(body)
    place = listed.index(struct.pack("<HHI", 273, 4, 1))
    listed = listed[: place + 8] + struct.pack("<I", at) + listed[place + 12 :]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + listed + b"\0\0\0\0" + body + raw


CELLS = "path string, band int, row_i int, col_i int, value double, error string"
GRIDS = "path string, bands int, width int, height int, a double, c double, e double, f double, epsg int, error string"


def _rows(path: str, data: bytes, report: bool):
    """Arrow batches of a file's cells."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    try:
        bands, grid = decode(data)
    except Exception as problem:  # any broken byte may raise anything
        if not report:
            raise ValueError(f"{path}: {problem}") from problem
        empty = [pa.array([None], k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([path]), *empty, pa.array([f"{type(problem).__name__}: {problem}"])], names)
        return
    for k, band in enumerate(bands):
        for first in range(0, band.shape[0], 256):
            part = band[first : first + 256].astype(np.float64)
            keep = np.ones(part.shape, bool) if grid["nodata"] is None else part != grid["nodata"]
            rows, cols = np.nonzero(keep)
            n = len(rows)
            numbers = [np.full(n, k + 1, np.int32), (rows + first).astype(np.int32), cols.astype(np.int32), part[keep]]
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *map(pa.array, numbers), pa.nulls(n, pa.string())], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif")
    return found.load(path).select("path", "content")


def cells(spark: SparkSession, path: str, errors: str = "fail") -> DataFrame:
    """CELLS of the .tif files below a path of any store that Spark reads."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content")):
                yield from _rows(name.as_py(), data.as_py(), errors == "report")

    return _files(spark, path).mapInArrow(run, CELLS)


def grids(spark: SparkSession, path: str) -> DataFrame:
    """GRIDS: a row for each .tif file, with the error of one that can't be read."""
    names = [c.split()[0] for c in GRIDS.split(", ")]

    def run(batches):
        for batch in batches:
            listed = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    bands, grid = decode(data.as_py())
                    listed.append({"path": name, "bands": len(bands), **{k: grid.get(k) for k in names[2:-1]}, "error": None})
                except Exception as problem:
                    listed.append(dict.fromkeys(names) | {"path": name, "error": f"{type(problem).__name__}: {problem}"})
            kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_pylist(listed, pa.schema(list(zip(names, kinds))))

    return _files(spark, path).mapInArrow(run, GRIDS)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): what was read, and (path, error) of the files that weren't."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def rasters(rows: DataFrame, by: str, grid: dict, dtype: str = "uint8", value: str = "cls") -> DataFrame:
    """(name, content): a file for each value of `by` from its cells (row_i, col_i, value); others hold nodata. One task holds one raster."""
    fill = grid["nodata"]

    def build(key, frame):
        band = np.full((grid["height"], grid["width"]), fill, dtype)
        band[frame["row_i"].to_numpy(), frame["col_i"].to_numpy()] = frame[value].to_numpy()
        return pd.DataFrame({"name": [f"{key[0]}.tif"], "content": [encode(band, grid)]})

    return rows.select(by, "row_i", "col_i", value).groupBy(by).applyInPandas(build, "name string, content binary")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str, report: bool = False):
        self.path, self.report = path, report

    def partitions(self):
        plain = self.path.removeprefix("file://")
        found = sorted(glob.glob(os.path.join(plain, "**/*.tif"), recursive=True)) if os.path.isdir(plain) else sorted(glob.glob(plain))
        if not found:
            raise ValueError(f"no files at {self.path}")
        return [File(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from _rows(partition.path, f.read(), self.report)


class Writer(DataSourceWriter):
    """Each row (name, content) becomes a file of the folder; a task that runs again replaces what it wrote."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        for row in iterator:
            place = os.path.join(self.path, os.path.basename(row["name"]))
            with open(f"{place}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, place)
        return WriterCommitMessage()


class GeoTiff(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("errors", "fail") == "report")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)

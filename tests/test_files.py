"""Rasters and vector files: what is written is read again, and broken files are told apart."""

import struct

import numpy as np
import pytest

from tarnwater.operators import catalog, merge
from tarnwater.plans import surface_water
from tarnwater.sources import geotiff, shapefile


def lzw(data):
    """A plain encoder of the same code widths."""
    bits, table, width, code = [], {bytes([k]): k for k in range(256)}, 9, b""
    free = 258
    emit = lambda v, w: bits.append(format(v, f"0{w}b"))
    emit(256, 9)
    for k in range(len(data)):
        byte = data[k : k + 1]
        if code + byte in table:
            code += byte
            continue
        emit(table[code], width)
        table[code + byte] = free
        free += 1
        code = byte
        if free == 4094:
            emit(256, width)
            table, width, free = {bytes([j]): j for j in range(256)}, 9, 258
        elif free > (1 << width) - 1:
            width += 1
    emit(table[code], width)
    free += 1
    emit(257, width + (free > (1 << width) - 1))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("data", [b"a", b"abababab" * 50, bytes(np.random.default_rng(1).integers(0, 256, 30_000, np.uint8)), b"\0" * 100_000])
def test_lzw(data):
    assert geotiff.unlzw(lzw(data)) == data


def tiff(raw, width, height, samples, bits, kind, pack, predictor, planar=1, parts=None):
    parts = parts or [raw]
    n, body, starts = 12, b"".join(parts), []
    end = 8 + 2 + 12 * n + 4
    sizes = [len(p) for p in parts]
    extra = struct.pack(f"<{len(parts)}I", *sizes) if len(parts) > 1 else b""
    at = end + 2 * len(extra)
    for size in sizes:
        starts.append(at)
        at += size
    first = struct.pack(f"<{len(parts)}I", *starts) if extra else b""
    place, length = (end, end + len(extra)) if extra else (starts[0], sizes[0])
    listed = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, pack), (262, 3, 1, 1), (273, 4, len(parts), place)]
    listed += [(277, 3, 1, samples), (278, 4, 1, height), (279, 4, len(parts), length), (284, 3, 1, planar), (317, 3, 1, predictor), (339, 3, 1, kind)]
    entries = b"".join(struct.pack("<HHI", t, k, c) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, c, v in listed)
    return b"II*\0" + struct.pack("<IH", 8, n) + entries + b"\0\0\0\0" + first + extra + body


def test_predictors_and_bands():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 60_000, (9, 14, 2), np.uint16)
    apart = np.diff(pixels, axis=1, prepend=np.zeros((9, 1, 2), np.uint16)).astype("<u2")
    back, _ = geotiff.decode(tiff(lzw(apart.tobytes()), 14, 9, 2, 16, 1, 5, 2))
    assert (back == pixels.transpose(2, 0, 1)).all()
    floats = rng.normal(size=(9, 14)).astype(">f4")
    planes = floats.view(np.uint8).reshape(9, 14, 4).transpose(0, 2, 1).reshape(9, -1)
    apart = np.diff(planes, axis=1, prepend=np.zeros((9, 1), np.uint8)).astype(np.uint8)
    assert (geotiff.decode(tiff(apart.tobytes(), 14, 9, 1, 32, 3, 1, 3))[0][0] == floats).all()
    planar = tiff(b"", 14, 9, 2, 16, 1, 1, 1, 2, [pixels[:, :, k].tobytes() for k in (0, 1)])
    assert (geotiff.decode(planar)[0] == pixels.transpose(2, 0, 1)).all()


def test_files_and_rejects(spark, tmp_path):
    bands = np.arange(2 * 5 * 6, dtype=np.int32).reshape(2, 5, 6)
    grid = {"a": 30.0, "c": 100.0, "e": -30.0, "f": 500.0, "nodata": 7, "epsg": 4326}
    geotiff.register(spark)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(bands, grid))
    (tmp_path / "cut.tif").write_bytes(geotiff.encode(bands, grid)[:-9])
    (tmp_path / "b.tif").write_bytes(b"nothing")
    for rows in (geotiff.cells(spark, str(tmp_path), "report"), spark.read.format("geotiff").option("errors", "report").load(str(tmp_path))):
        found, rejects = geotiff.split(rows)
        assert {(r["band"], r["row_i"], r["col_i"]): r["value"] for r in found.collect()} == {(k + 1, i, j): v for (k, i, j), v in np.ndenumerate(bands) if v != 7}
        assert sorted(r["path"].rsplit("/", 1)[1] for r in rejects.collect()) == ["b.tif", "cut.tif"]
    with pytest.raises(Exception, match="b.tif|cut.tif"):
        geotiff.cells(spark, str(tmp_path)).count()
    grids = geotiff.grids(spark, str(tmp_path))
    good = catalog.in_crs(grids).collect()
    assert len(good) == 1 and good[0]["bands"] == 2 and good[0]["f"] == 500.0
    catalog.same(grids.where("error is null"))
    with pytest.raises(ValueError, match="differ"):
        catalog.same(grids, ["epsg"])


def test_rasters_are_written(spark, tmp_path):
    geotiff.register(spark)
    data = [(m, r, c, (m + r + c) % 4) for m in (199501, 199502) for r in range(3) for c in range(4) if r + c]
    cells = spark.createDataFrame(data, "month_key int, row_i int, col_i int, cls int")
    grid = {"width": 4, "height": 3, "a": 1.0, "c": 0.0, "e": -1.0, "f": 0.0, "nodata": 255, "epsg": 32610}
    geotiff.rasters(cells, "month_key", grid).write.format("geotiff").mode("append").save(str(tmp_path / "out"))
    back = geotiff.cells(spark, str(tmp_path / "out")).collect()
    assert sorted((int(r["path"].rsplit("/", 1)[1][:6]), r["row_i"], r["col_i"], int(r["value"])) for r in back) == sorted(data)
    assert {r["epsg"] for r in geotiff.grids(spark, str(tmp_path / "out")).collect()} == {32610}


def shapes(*polygons):
    out = b""
    for k, rings in enumerate(polygons):
        points = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body = body if rings else struct.pack("<i", 0)
        out += struct.pack(">2i", k + 1, len(body) // 2) + body
    return struct.pack(">i", 9994) + b"\0" * 96 + out


def attributes(names, rows, width=12):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for n in names) + b"\r"
    body = b"".join(b" " + b"".join(v.encode("latin-1").ljust(width) for v in r) for r in rows)
    return b"\x03\0\0\0" + struct.pack("<IHH", len(rows), 32 + len(head), 1 + width * len(names)) + b"\0" * 20 + head + body


def test_shapefiles(spark, tmp_path):
    box = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    for name, fields, rows in (("a", ["lake_name", "wse"], [("Álamo", "1.5"), ("Big Alamo", "2.5"), ("", "x")]), ("b", ["GEO_NAME", "wse"], [("One", ""), ("Two", "")]), ("c", ["id"], [("7",)])):
        (tmp_path / f"{name}.shp").write_bytes(shapes(*([box, hole] if k % 2 == 0 else [] for k in range(len(rows)))))
        (tmp_path / f"{name}.dbf").write_bytes(attributes(fields, rows))
    found = shapefile.features(spark, str(tmp_path))
    by = {(r["path"][-5], r["pos"]): r for r in shapefile.named(found).collect()}
    assert {k: r["lake_name"] for k, r in by.items()} == {("a", 0): "Álamo", ("a", 1): "Big Alamo", ("a", 2): None, ("b", 0): "One", ("b", 1): "Two", ("c", 0): "Lake_0"}
    assert [[(p["x"], p["y"]) for p in ring] for ring in by["a", 0]["rings"]] == [box, hole] and by["a", 1]["rings"] is None
    assert shapefile.lake_polygons(found).count() == 3
    assert [r["wse"] for r in shapefile.first_level(found, "alamo").collect()] == [2.5]


def test_common_grid():
    one = {"width": 10, "height": 10, "a": 1.0, "c": 0.0, "e": -1.0, "f": 0.0}
    assert merge.common_grid(one, one | {"c": 4.0, "a": 2.0}) == one | {"width": 6, "c": 4.0}
    with pytest.raises(ValueError, match="overlap"):
        merge.common_grid(one, one | {"c": 10.0})


def test_files_to_daily_mosaics(spark, tmp_path):
    fine = {"a": 1.0, "c": 0.0, "e": -1.0, "f": 0.0, "nodata": 255, "epsg": 32610}
    one, two = np.array([[0, 1, 255, 9]] * 4, np.uint8), np.array([[1, 0]] * 2, np.uint8)
    (tmp_path / "X_20200105_INTR.tif").write_bytes(geotiff.encode(one, fine))
    (tmp_path / "Y_20200105_INTR.tif").write_bytes(geotiff.encode(two, fine | {"a": 2.0, "e": -2.0, "c": 2.0}))
    (tmp_path / "Z_20200106_INTR.tif").write_bytes(b"II*")
    scenes, grid, rejects = surface_water.scenes_of_files(spark, str(tmp_path))
    assert (grid["width"], grid["height"]) == (6, 4) and rejects.count() == 1
    found = {(r["row_i"], r["col_i"]): (str(r["obs_date"]), r["cls"]) for r in surface_water.daily(scenes).collect()}
    assert found == {(r, c): ("2020-01-05", v) for r in range(4) for c, v in enumerate([0, 1, 1, 1, 0, 0])}
    (tmp_path / "W_20200107_INTR.tif").write_bytes(geotiff.encode(one, fine | {"epsg": 32611}))
    with pytest.raises(ValueError, match="differ"):
        surface_water.scenes_of_files(spark, str(tmp_path))

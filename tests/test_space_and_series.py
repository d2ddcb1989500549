"""Plane operators against brute force, series functions on exact cases, sources and names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwater.functions import geo, names, stl
from tarnwater.functions.distributions import f_tail, normal_tails, t_tails
from tarnwater.operators import catalog, compare, derivatives, elevation, metrics, series, spatial
from tarnwater.operators import monthly as monthly_operators
from tarnwater.sources import geotiff, readers, sinks


def flood(cells, diagonal):
    left, out = set(cells), {}
    while left:
        start = min(left)
        todo, body = [start], {start}
        left.discard(start)
        while todo:
            r, c = todo.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    n = (r + i, c + j)
                    if (diagonal or i * j == 0) and n in left:
                        left.discard(n)
                        body.add(n)
                        todo.append(n)
        out |= dict.fromkeys(body, start)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_across_tiles(spark, diagonal):
    rng = random.Random(5)
    grids = {m: {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.55} for m in (1, 2)}
    df = spark.createDataFrame([(m, r, c) for m, g in grids.items() for r, c in g], "month_key int, row_i int, col_i int")
    got = spatial.label_components(df, ["month_key"], diagonal=diagonal, tile=4).collect()
    for m, g in grids.items():
        expected = flood(g, diagonal)
        named = {(r["row_i"], r["col_i"]): r["component"] for r in got if r["month_key"] == m}
        assert set(named) == g
        assert len(set(named.values())) == len(set(expected.values())) == len({(named[k], expected[k]) for k in g})


def test_perimeter_of_known_shapes(spark):
    square = [(1, r, c) for r in range(3) for c in range(3)]
    labelled = spark.createDataFrame([(*x, 7) for x in square], "month_key int, row_i int, col_i int, component long")
    assert spatial.perimeters(labelled, ["month_key"]).first()["perimeter"] == pytest.approx(8.0)
    single = spark.createDataFrame([(1, 0, 0, 7)], "month_key int, row_i int, col_i int, component long")
    assert spatial.perimeters(single, ["month_key"]).first()["perimeter"] == 0.0


def test_dilation_is_manhattan(spark):
    got = spatial.dilate(spark.createDataFrame([(0, 0)], "row_i int, col_i int"), [], steps=7)
    assert got.count() == 113


def test_polygon_predicates(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    points = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (7.0, 8.0)], "x double, y double")
    rows = points.select(spatial.inside(F.col("x"), F.col("y"), ring).alias("i"), spatial.polygon_distance(F.col("x"), F.col("y"), ring).alias("d")).collect()
    assert [r["i"] for r in rows] == [True, False, False]
    assert [r["d"] for r in rows] == pytest.approx([0.0, 1.0, 5.0])


def meets(triangle, r, c):
    """Whether a triangle meets a unit square: neither the axes nor the triangle's normals separate them."""
    square = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)]
    sides = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(triangle, triangle[1:] + triangle[:1])]
    for nx, ny in [(1, 0), (0, 1)] + [(-dy, dx) for dx, dy in sides]:
        one, two = ([nx * x + ny * y for x, y in shape] for shape in (triangle, square))
        if max(one) < min(two) or max(two) < min(one):
            return False
    return True


def test_first_and_last_dates_are_those_of_the_stack(spark):
    """A cell first seen on the fifth of eight dates has no initial class, one seen on the second date only has one."""
    days = ["2020-01-%02d" % k for k in range(1, 9)]
    rows = [(0, 0, d, 1) for d in days] + [(0, 1, d, 2) for d in days[4:]] + [(0, 2, days[1], 1)] + [(0, 3, days[3], 1)]
    stack = spark.createDataFrame(rows, "row_i int, col_i int, day string, cls int").withColumn("obs_date", F.to_date("day"))
    ends = {r["col_i"]: (r["initial"], r["final"]) for r in derivatives.first_and_last(stack).collect()}
    assert ends == {0: (1, 1), 1: (None, 2), 2: (1, None), 3: (None, None)}
    change = {r["col_i"]: round(r["change"], 6) for r in derivatives.water_change(stack).collect()}
    assert change == {0: 0.0, 1: 1.0, 2: round(-1 / 3, 6), 3: 0.0}


def test_shares_of_a_date_are_of_the_grid(spark):
    obs = spark.createDataFrame([(0, 0, "2020-01-01", 1)], "row_i int, col_i int, obs_date string, cls int")
    stats = spark.createDataFrame([(0, 0, 1.0)], "row_i int, col_i int, water_prob double")
    row = monthly_operators.daily_quality(obs, stats, cells=100).first()
    assert row["valid_frac"] == 0.01 and not row["passes"]


def test_rasterize_and_bilinear(spark):
    grid = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(6) for c in range(6)], "row_i int, col_i int, v double")
    ring = [(1.2, 1.2), (2.8, 1.2), (2.8, 2.8), (1.2, 2.8)]
    polygons = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x: double, y: double>>")
    got = {tuple(r) for r in spatial.rasterize(grid, polygons).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}
    rng = random.Random(2)
    for _ in range(3):
        triangle = [(rng.uniform(-1, 7), rng.uniform(-1, 7)) for _ in range(3)]
        one = spark.createDataFrame([([{"x": x, "y": y} for x, y in triangle],)], "ring array<struct<x: double, y: double>>")
        assert {tuple(r) for r in spatial.rasterize(grid, one).collect()} == {(r, c) for r in range(6) for c in range(6) if meets(triangle, r, c)}
    points = spark.createDataFrame([(1.5, 2.25)], "x double, y double")
    assert spatial.bilinear(grid, points, "v").first()["v"] == pytest.approx(24.0)


def test_edges_leave_cloudy_shores_out(spark):
    wet = {(2, 2), (2, 3)}
    grid = spark.createDataFrame([(1, r, c, 1 if (r, c) in wet else 253 if (r, c) == (2, 5) else 0) for r in range(8) for c in range(8)], "month_key int, row_i int, col_i int, cls int")
    got = {(r["row_i"], r["col_i"]) for r in elevation.water_edges(grid, ["month_key"], 64, cloud_steps=1).collect()}
    assert got == {(1, 2), (1, 3), (3, 2), (3, 3), (2, 1)}


def monthly(spark, values):
    return spark.createDataFrame([(199501 + k, float(v)) for k, v in enumerate(values)], "month_key int, v double")


def test_trends(spark):
    mk = series.mann_kendall(monthly(spark, [1, 2, 3, 4]), "v").first()
    assert (mk["s"], round(mk["var_s"], 3), round(mk["z"], 3), round(mk["p_value"], 4), mk["trend"]) == (6, 8.667, 1.698, 0.0894, "no significant trend")
    assert series.sens_slope(monthly(spark, [1, 2, 4]), "v").first()[0] == 1.5
    assert series.sens_slope(monthly(spark, [1]), "v").first()[0] == 0.0
    fit = series.linear_trend(monthly(spark, [1, 2, 4, 4]), "v").first()
    assert fit["slope"] == pytest.approx(1.1) and fit["r_squared"] == pytest.approx(0.8963, abs=1e-4) and fit["p_value"] == pytest.approx(0.0533, abs=1e-3)


def test_tails():
    assert normal_tails(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert t_tails(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert f_tail(3.492828477, 2, 20) == pytest.approx(0.05, abs=1e-8)


def test_stl_on_exact_series(spark):
    season = np.tile(np.arange(12) - 5.5, 8)
    trend, cycle, rest = stl.stl(season + 0.5 * np.arange(96))
    assert np.abs(rest).max() < 1e-6 and np.abs(trend - 0.5 * np.arange(96)).max() < 1e-6 and np.abs(cycle - season).max() < 1e-6
    short = series.decompose(monthly(spark, [1, 2, 3]), "v").collect()
    assert len(short) == 3 and short[0]["v_trend"] is None


def test_cross_correlation_pairs(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=40), rng.normal(size=40)
    pairs = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "month_key int, x double, y double")
    got = {r["lag"]: r["r"] for r in compare.cross_correlation(pairs, 3).collect()}
    for lag in range(-3, 4):
        a, b = (x[:lag], y[-lag:]) if lag < 0 else (x[lag:], y[:-lag]) if lag > 0 else (x, y)
        assert got[lag] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert compare.cross_correlation(pairs.limit(5), 3).count() == 0


def test_anomalies_average_to_zero(spark):
    rows = spark.createDataFrame([(200001 + 100 * (k // 12) + k % 12, k % 12 + 1, math.sin(k) * 5 + k) for k in range(60)], "month_key int, month_i int, v double")
    for r in series.anomalies(rows, "v").groupBy("month_i").agg(F.avg("v_anomaly").alias("m")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-9)


def test_names_and_places(spark):
    one = spark.createDataFrame([("LE07_CU_002009_20030531_x", "CACHUMA LAKE;LAKE CACHUMA", "SWOT_L2_HR_LakeSP_Obs_007_123_NA_20230801T010203_x")], "a string, b string, c string")
    row = one.select(names.satellite(F.col("a")).alias("sat"), names.slc_off(F.col("a")).alias("off"), names.simple_lake(F.col("b")).alias("lake"), names.orbit(F.col("c")).alias("o")).first()
    assert (row["sat"], row["off"], row["lake"]) == (7, True, "CACHUMA LAKE")
    assert (row["o"]["cycle"], row["o"]["pass"], row["o"]["stamp"]) == ("007", "123", "20230801T010203")
    zone = spark.createDataFrame([(34.58555, -119.9792), (85.0, 0.0)], "lat double, lon double").select(geo.utm_zone(F.col("lat"), F.col("lon")).alias("z")).collect()
    assert [r["z"] for r in zone] == ["11S", "31X"]
    ring = spark.createDataFrame([("POLYGON ((-120.15 34.5, -119.9 34.5, -119.9 34.66, -120.15 34.5))",)], "w string").select(geo.ring_bounds(geo.wkt_ring(F.col("w")), 1).alias("b")).first()["b"]
    assert tuple(ring) == pytest.approx((-120.2, 34.5, -119.9, 34.7))
    values = spark.createDataFrame([("3/4",), ("0.5",), ("x",)], "t string").select(names.fraction(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in values] == [0.75, 0.5, None]


def test_chunks_cover_a_span_without_gaps(spark):
    chunks = catalog.date_chunks("2023-01-01", "2023-03-07", spark)
    assert catalog.gaps(chunks).count() == 0
    assert chunks.agg(F.sum(F.datediff("stop", "start") + 1)).first()[0] == 66


def test_geotiff_round_trip(spark, tmp_path):
    band = np.arange(600, dtype=np.uint8).reshape(20, 30) % 7
    grid = {"a": 30.0, "c": 1000.0, "e": -30.0, "f": 5000.0, "nodata": 3}
    data = geotiff.encode(band, grid)
    back, found = geotiff.decode(data)
    assert (back[0] == band).all() and found["a"] == 30.0 and found["f"] == 5000.0 and found["nodata"] == 3
    (tmp_path / "a.tif").write_bytes(data)
    geotiff.register(spark)
    rows = spark.read.format("geotiff").load(str(tmp_path)).collect()
    assert len(rows) == (band != 3).sum() and all(band[r["row_i"], r["col_i"]] == r["value"] for r in rows)
    with pytest.raises(ValueError):
        geotiff.decode(b"nothing")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "i.csv").write_text("date,name,oni\n199501,a,0.5\n1995-02-01,b,\n199503,c,-1\n")
    rows = readers.index_series(spark, str(tmp_path / "i.csv")).orderBy("month_key").collect()
    assert [(r["month_key"], r["value"]) for r in rows] == [(199501, 0.5), (199502, None), (199503, -1.0)]
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    assert len(readers.geojson(spark, str(tmp_path / "c.json")).first()["ring"]) == 4
    df = spark.createDataFrame([(1, 5), (2, 6)], "month_key int, v int")
    sinks.partitions(df, str(tmp_path / "out"), ["month_key"])
    assert sinks.unwritten(spark.createDataFrame([(2, 1), (3, 1)], "month_key int, v int"), str(tmp_path / "out"), "month_key").collect()[0]["month_key"] == 3
    assert sinks.unwritten(df, str(tmp_path / "none"), "month_key").count() == 2
    (tmp_path / "g.csv").write_text("DATE,RES ELE FEET\n2020-01-01,700\n2020-01-02,0\n2020-01-03,--\n")
    assert [r["level"] for r in readers.gauge(spark, str(tmp_path / "g.csv")).orderBy("day").collect()] == [pytest.approx(213.36), None, None]


def test_whole_plan(spark):
    from tarnwater.plans import surface_water as plan

    rng = random.Random(1)
    rows = [(r, c, f"19{95 + m // 12}-{m % 12 + 1:02d}-{d:02d}", 1 if r < 4 else rng.choice([0, 0, 0, 9]), k) for m in range(4) for d in (3, 13, 23) for r in range(8) for c in range(8) for k in range(2)]
    scenes = spark.createDataFrame(rows, "row_i int, col_i int, day string, cls int, file_pos int").withColumn("obs_date", F.to_date("day")).drop("day")
    stats, cleaned = plan.composites(plan.with_inwam(plan.daily(scenes), None), 64)
    out = plan.series_of(cleaned, stats, 0.0009).orderBy("month_key").collect()
    assert len(out) == 4 and all(r["num_water_bodies"] == 1 and r["total_area_km2"] == pytest.approx(32 * 0.0009) for r in out)
    assert metrics.one_per_month(cleaned, cleaned).count() == cleaned.count()
    assert set(plan.trends(plan.series_of(cleaned, stats, 0.0009))) == {"linear", "mann_kendall", "sen"}


def test_components_of_chains_stars_and_loops(spark):
    from tarnwater.operators.graph import components

    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(300, 200), (200, 250), (250, 300), (5, 5), (None, 4), (7, None), (170, 171)]
    df = spark.createDataFrame([(b, a) if a and a % 2 else (a, b) for a, b in edges], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 180), 100) | dict.fromkeys((200, 250, 300), 200)
    assert components(df.limit(0)).count() == 0

"""Rules on small cases worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwater.model import INTR, CleanParams, Product
from tarnwater.operators import clean, merge, monthly, statistics

CELL = ["row_i", "col_i"]


def scenes(spark, values):
    return spark.createDataFrame([(0, 0, k, v, 100 + k) for k, v in enumerate(values)], "row_i int, col_i int, file_pos int, cls int, acq_min int")


@pytest.mark.parametrize("values, expected", [([255, 17, 9, 33], 9), ([255, 17, 33], 17), ([0, 9, 4], 4), ([255, 255], 255), ([9, 0], 0)])
def test_priority_merge(spark, values, expected):
    assert merge.priority_merge(scenes(spark, values), CELL, INTR).first()["cls"] == expected


def test_priority_merge_without_priorities(spark):
    assert merge.priority_merge(scenes(spark, [255, 7, 3]), CELL, Product("x", ())).first()["cls"] == 7


def test_priority_merge_equals_sequential_overwriting(spark):
    rng, order, data, expected = random.Random(3), INTR.priority, [], {}
    for cell in range(300):
        now = 255
        for pos in range(rng.randint(1, 6)):
            v = rng.choice([0, 1, 2, 3, 4, 9, 17, 33, 255])
            data.append((cell, 0, pos, v))
            if v != 255:
                if v in order and (now not in order or order.index(v) < order.index(now)):
                    now = v
                elif v not in order and now == 255:
                    now = v
        expected[cell] = now
    df = spark.createDataFrame(data, "row_i int, col_i int, file_pos int, cls int")
    assert {r["row_i"]: r["cls"] for r in merge.priority_merge(df, CELL, INTR).collect()} == expected


@pytest.mark.parametrize("values, expected", [([0, 1], (0, 100)), ([255, 0, 2, 1], (1, 103)), ([2, 2, 1, 1], (1, 102)), ([255, 0], (255, 100))])
def test_min_positive(spark, values, expected):
    assert tuple(merge.min_positive_merge(scenes(spark, values), CELL).select("cls", "acq_min").first()) == expected


@pytest.mark.parametrize("values, expected", [([0, 0, 1, 1, 255], 0), ([255, 255], 255), ([3, 3, 1], 3)])
def test_mode(spark, values, expected):
    assert statistics.mode_class(scenes(spark, values)).first()["mode_class"] == expected


def test_masks_overlap(spark):
    row = spark.createDataFrame([(0.25,)], "p double").select(*(c.alias(k) for k, c in statistics.masks(F.col("p")).items())).first()
    assert (row["persistent"], row["stable_land"], row["ephemeral"]) == (False, True, True)


VOTES = [
    ([1, 1, 0], (False, False, 0.5), 1),
    ([3, 0, 0], (False, False, 0.5), 3),
    ([2, 0, 0, 0], (False, False, 0.0), 3),
    ([9, 9, 9], (False, False, 0.5), 9),
    ([255, 255], (False, False, 0.5), 255),
    ([9, 255], (False, False, 0.5), 9),
    ([255, 255], (False, True, 0.0), 0),
    ([1, 1, 0], (False, True, 0.2), 1),
    ([0, 0, 9], (True, False, 0.9), 1),
]


@pytest.mark.parametrize("values, cell, expected", VOTES)
def test_vote(spark, values, cell, expected):
    obs = spark.createDataFrame([(199501, 0, 0, v, None) for v in values], "month_key int, row_i int, col_i int, cls int, inwam int")
    stats = spark.createDataFrame([(0, 0, *cell)], "row_i int, col_i int, persistent boolean, stable_land boolean, water_prob double")
    assert monthly.monthly_vote(obs, stats).first()["cls"] == expected


def filled(spark, values, with_inwam, **params):
    months = params.pop("months", range(199501, 199501 + len(values)))
    masked = spark.createDataFrame([(m, 0, 0, v, v, 0, 7) for m, v in zip(months, values)], "month_key int, row_i int, col_i int, cls int, cleaned int, confidence int, mode_class int")
    return [(r["cleaned"], r["confidence"]) for r in clean.temporal_fill(masked, CleanParams(**params), with_inwam).orderBy("month_key").collect()]


def test_temporal_fill(spark):
    assert filled(spark, [1, 9, 3], False)[1] == (1, 4)
    assert filled(spark, [0, 9, 2], True)[1] == (2, 4)
    assert filled(spark, [9, 9, 9, 9, 1], True)[0] == (7, 5)
    assert filled(spark, [1, 9], False, months=[199501, 199507], calendar_offsets=True)[1] == (7, 5)


def test_small_bodies_go(spark):
    cells = [(199501, r, c, 1 if (r, c) in {(0, 0), (1, 1), (5, 5)} else 0, 0) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(cells, "month_key int, row_i int, col_i int, cleaned int, confidence int")
    out = clean.remove_small_water(df, CleanParams(min_water_pixels=2)).where("cleaned = 1").select("row_i", "col_i").collect()
    assert sorted(map(tuple, out)) == [(0, 0), (1, 1)]


def test_merge_of_no_rows(spark):
    empty = scenes(spark, [1]).where("cls = 5")
    assert merge.priority_merge(empty, CELL, INTR).count() == 0
    assert statistics.water_statistics(empty).count() == 0


def test_stream_keeps_the_same_statistics(spark, tmp_path):
    from tarnwater.streaming import counters

    days = [dt.date(2020, 1, d) for d in range(1, 7)]
    rows = [(d, r, c, (r * 3 + c + d.day) % 5) for d in days for r in range(4) for c in range(4)]
    obs = spark.createDataFrame(rows, "obs_date date, row_i int, col_i int, cls int")
    for k in range(2):
        obs.where((F.dayofmonth("obs_date") % 2) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
        counters.follow(stream, str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination()
    expected = statistics.water_statistics(obs)
    got = counters.statistics(spark, str(tmp_path / "counts"))
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    counters.compact(spark, str(tmp_path / "counts"), str(tmp_path / "one"))
    assert counters.statistics(spark, str(tmp_path / "one")).count() == 16


def test_intermediates_can_be_deleted(spark):
    from tarnwater import storage

    df = storage.stored(spark.range(5), "some")
    assert df.count() == 5
    storage.dropped(spark, df)
    path = storage.stored(spark.range(3), "more").inputFiles()[0].removeprefix("file:")
    import os

    assert os.path.exists(path)
    storage.release(spark)
    assert not os.path.exists(path)

"""Embedding dedup against all pairs."""

import numpy as np
import pytest

from tarnwater.llm import embedding_dedup
from tarnwater.llm.common import table


def brute(rows, threshold=0.98):
    n = len(rows)
    unit = []
    for _, v, _ in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(np.float64) if ok else None
        unit.append(a / np.linalg.norm(a / np.abs(a).max()) / np.abs(a).max() if ok else None)
    label, links = list(range(n)), [0] * n

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), links[i], str(least.get(find(i)))) for i in range(n))


def make(seed, groups=12, each=9, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.normal(size=dim)
        for _ in range(each):
            rows.append((len(rows), (center + rng.normal(size=dim) * 0.12 * np.linalg.norm(center) / dim**0.5).astype(np.float32).tolist(), g % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * dim, 1), (1003, [float("nan")] * dim, 1), (1004, [None] + [1.0] * (dim - 1), 1), (1005, rows[0][1], None), (1006, rows[0][1], rows[0][2]), (1006, rows[0][1], rows[0][2]), (None, rows[5][1], rows[5][2]), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (1009, [1e-30] * dim, 2), (1010, [1e30] * dim, 2)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 4])
def test_links_equal_all_pairs(spark, chunk):
    rows = make(3)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, node string, n_links int")
    got = embedding_dedup.near_duplicates(df, chunk=chunk).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_a_table(spark, sf):
    vectors = table(spark, sf.replace("0.001", "0.01"), "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    got = embedding_dedup.near_duplicates(vectors).collect()
    expected = brute(rows)
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * sum(x[1] for x in expected)
    assert all(a[1] >= b for a, b in zip(expected, [r["n_links"] for r in sorted(got, key=lambda r: str(r["vec_id"]))]))


def test_repeated_rows_leave_one(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "the same text of some words here", "en", "s", 1)] * 3 + [(2, "the same text of some words here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.distinct_texts(spark, docs, "").collect()
    assert [r["doc_id"] for r in out] == [1]

"""The pipeline's stages and run() against brute-force versions, on a small fixture with planted copies and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwater.llm import bpe_codec, common, language_id, mixing, near_copies, quality
from tarnwater.llm.common import table

from .test_documents import brute_language
from .test_near_copies import survivors

pipeline = pytest.importorskip("corpus_pipeline")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def fixture(spark, sf):
    """Documents of the smallest table, near copies of some at similarities from 0.7 to 0.97, exact copies, and rows without text."""
    rng = random.Random(3)
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [r for r in rows if len(r[1] or "") < 6000][:90]
    for k, (_, text, lang, source, _) in enumerate(rows[:30]):
        words = (text or "").split()
        for _ in range(1 + len(words) // rng.choice([40, 80, 200]) if k % 3 else 0):
            words[rng.randrange(len(words))] = "zyx%d" % rng.randrange(1000)
        rows.append((100_000 + k, " ".join(words), lang, source, len(" ".join(words))))
    rows += [(200_000, None, "en", "a", 0), (200_001, "", "en", None, 0), (200_002, "12 34", None, "a", 5), (200_003, None, None, None, None)]
    return rows


def key(row):
    return tuple(str(x) for x in row)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def brute_stage_one(rows):
    found = brute_language([(r[0], r[1], r[2]) for r in rows])
    return [r for r, (_, lang, score) in zip(rows, found) if lang != "und" and score >= 0.4 * len(r[1]) / (len(r[1]) + 400)]


def brute_stage_two(rows, labels):
    """Features row by row, scores by adding up table entries one by one."""
    classes = quality._classes()
    features = {i: np.array(quality.text_features(t or "", classes), np.float32).astype(float) for i, t, *_ in rows}
    known = [(i, y) for i, y in labels if i in features and y is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    known.sort(key=lambda p: (p[0], tuple(features[p[0]])))
    model = quality.fit(np.array([features[i] for i, _ in known]), np.array([y for _, y in known], float))
    kept = []
    for r in rows:
        total = model.base
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, features[r[0]])]
        total += sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[bins[i] // model.coarse, bins[j] // model.coarse] for (i, j), t in model.pairs.items())
        if 1 / (1 + np.exp(-total)) >= 0.3:
            kept.append(r)
    return kept


def brute_stage_three(rows):
    left = set(survivors([(r[0], r[1]) for r in rows]))
    return [r for r in rows if r[0] in left]


def check_mix(before, after, share=1.5, most=2):
    """Words taken of each source meet the targets; each row is a run of a document's words; no word is taken more often than `most`."""
    texts = {r[0]: WORDS.findall(r[1] or "") for r in before}
    facts = {r[0]: r[2:4] for r in before}
    sources = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(texts[r[0]]) for r in before if r[3] == s) for s in sources]
    goal = mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))], share, most)
    hits = {i: np.zeros(len(w), int) for i, w in texts.items()}
    for i, text, lang, source, n_chars in after:
        words = WORDS.findall(text)
        assert facts[i] == (lang, source) and n_chars == len(text) and words
        places = [k for k in range(len(texts[i]) - len(words) + 1) if texts[i][k : k + len(words)] == words]
        at = min(places, key=lambda k: hits[i][k : k + len(words)].sum())
        hits[i][at : at + len(words)] += 1
    for s, g in zip(sources, goal):
        assert abs(sum(hits[r[0]].sum() for r in before if r[3] == s) - g) <= 1
    assert all(not len(h) or h.max() <= most for h in hits.values())


def brute_digests(rows, library):
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_each_stage_equals_brute_force(spark, sf, fixture, library):
    labels = [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality").collect()]
    docs, rows = frame(spark, fixture), fixture
    for (_, stage), brute in zip(pipeline.STAGES[:3], (brute_stage_one, lambda r: brute_stage_two(r, labels), brute_stage_three)):
        docs, rows = stage(spark, docs, sf), brute(rows)
        got = [tuple(r) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(key, got)) == sorted(map(key, rows))
        docs = frame(spark, got)
    assert 0 < len(rows) < len(fixture) - 10
    mixed = pipeline.mixed_sources(spark, docs, sf)
    after = [tuple(r) for r in mixed.collect()]
    check_mix(rows, after)
    last = pipeline.token_digests(spark, frame(spark, after), sf)
    assert sorted(map(key, last.collect())) == sorted(map(key, brute_digests(after, library)))


def test_run_equals_its_stages_one_by_one(spark, sf, library):
    labels = [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality").collect()]
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    kept = brute_stage_three(brute_stage_two(brute_stage_one(rows), labels))
    mixed = [tuple(r) for r in mixing.mixed_documents(frame(spark, kept)).drop("shard").collect()]
    check_mix(kept, mixed)
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(key, out.collect())) == sorted(map(key, brute_digests(mixed, library)))


CLASHING = ["size", "lo", "hi", "g", "p", "_id", "_key", "k1", "k2", "part", "copy", "shard", "order", "key", "root", "id", "n", "row", "s", "_k1", "taken", "x", "score", "fp"]


def test_stages_take_odd_tables_and_columns_of_any_name(spark, sf, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain
    for name in CLASHING:
        wide = wide.withColumn(name, F.lit(f"own {name}"))
    for name, stage in pipeline.STAGES:
        narrow = sorted(key(r) for r in stage(spark, plain, sf).collect())
        out = stage(spark, wide, sf)
        rows = out.collect()
        if name != "bpe":
            assert out.columns == wide.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
            rows = [tuple(r)[:5] for r in rows]
        assert sorted(map(key, rows)) == narrow
        for frame_ in (plain.limit(0), plain.withColumn("text", F.lit(None).cast("string"))):
            stage(spark, frame_, sf).collect()


def test_copies_are_mixed_as_often_as_they_are_there(spark, monkeypatch):
    rows = [(None, "a b c d e", "en", "s", 9)] * 7 + [(1, "x y z", "en", "t", 5), (1, "x y z", "en", "s", 5), (1, "u v", "en", "t", 3)]
    for copies in (2, 1000):
        monkeypatch.setattr(mixing, "COPIES", copies)
        out = mixing.mixed_documents(frame(spark, rows), block_words=4).collect()
        words = sum(len(r["text"].split()) for r in out)
        sizes = [38, 5]
        assert words == sum(round(t) for t in mixing.targets(sizes, [5, 2]))
        assert all(r["text"] in " ".join("a b c d e".split()) or r["doc_id"] == 1 for r in out)
        assert [r["shard"] for r in out] == sorted(r["shard"] for r in out)


def test_large_populations_are_dealt_in_strata():
    quotas = [3_000_000_000, 7, 0, 900_000_123]
    got = mixing.split_quotas(quotas, 6, 4)
    assert got.sum(axis=1).tolist() == quotas and got.sum(axis=0).max() - got.sum(axis=0).min() <= 100
    assert (mixing.split_quotas([50, 60], 3, 1, most=20).sum(axis=1) == [50, 60]).all()


def test_digests_read_small_batches_and_leave_the_settings(spark, sf, monkeypatch):
    def sizes(docs, tokenizer):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

        return docs.mapInArrow(run, "n long")

    monkeypatch.setattr(bpe_codec, "round_trip", sizes)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    rows = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    got = [r["n"] for r in pipeline.token_digests(spark, rows, sf).collect()]
    assert sum(got) == 5000 and max(got) <= 1000 and spark.conf.get(name) == was


def test_executors_give_heap_back_before_each_stage(spark, sf, fixture):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = frame(spark, fixture[:20])
    for _, stage in pipeline.STAGES:
        before = full()
        stage(spark, docs, sf)
        assert full() > before


def test_marked_rows_send_only_keys_to_python(spark):
    marks = np.zeros(1000, bool)
    marks[[0, 7, 8, 991, 999]] = True
    held = spark.sparkContext.broadcast(np.packbits(marks))
    rows = spark.range(-3000, 3000).select(F.col("id").alias("k"), F.lit("text").alias("text"))
    for wanted in (True, False):
        out = near_copies._marked(rows, held, 1000, "k", wanted)
        assert sorted(r["k"] for r in out.collect()) == [k for k in range(-3000, 3000) if marks[k % 1000] == wanted]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and re.findall(r"inside\((.*?)\)", plan)[0].split("#")[0] == "id"


def test_a_worker_forgets_language_vectors_too():
    language_id._state()
    common.forgotten()
    assert not language_id._KEPT and len(language_id.trigrams("some words")[0])

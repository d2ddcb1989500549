"""Mixing, language, SimHash, fingerprints, language model and quality on odd texts and against brute force."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tarnwater.llm import language_id, lm_scoring, mixing, quality, simhash, weighted_fingerprints
from tarnwater.llm.common import forgotten, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORDS.findall(text or ""))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- mixing


def test_targets_fill_up_to_the_cap():
    got = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5])
    assert got[0] == 20 and got[3] == 0 and sum(got) == pytest.approx(3015) and got[1] <= 2000 and got[2] == pytest.approx(2995 - got[1])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_splits_are_exact():
    got = mixing.split_quotas([1000, 3, 0, 77], 13, 4)
    assert got.sum(axis=1).tolist() == [1000, 3, 0, 77] and got.sum(axis=0).max() - got.sum(axis=0).min() <= 4


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_one(n):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_mix_of_odd_texts(spark, odd, block):
    rows = mixing.mix(odd, block_words=block, shards=3).collect()
    source = odd.select("doc_id", "text", "source").collect()
    assert sorted(r["size"] for r in rows) == sorted(n_words(r["text"]) for r in source)
    sizes = Counter()
    for r in source:
        sizes[r["source"]] += n_words(r["text"])
    assert sorted({r["source_size"] for r in rows}) == sorted(sizes.values())
    for size in set(sizes.values()):
        own = [r for r in rows if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["to"] - s["from"] for s in r["spans"]) for r in rows)
    again = mixing.mix(odd, block_words=block, shards=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_of_a_table_takes_each_word_as_often_as_said(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.mix(docs, block_words=50, shards=8).collect()
    for r in rows:
        hits = np.zeros(r["size"], int)
        for s in r["spans"]:
            hits[s["from"] : s["to"]] += 1
        assert hits.sum() == r["taken"] and (not len(hits) or hits.max() <= 2)
    shards = Counter()
    for r in rows:
        for s in r["spans"]:
            shards[s["shard"]] += s["to"] - s["from"]
    assert len(shards) == 8 and max(shards.values()) < 1.3 * min(shards.values())
    texts = mixing.mixed_documents(docs, block_words=50).collect()
    assert sum(n_words(r["text"]) for r in texts) == sum(r["taken"] for r in rows)


# --- language


def test_language_on_held_out_rows(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_language_of_odd_texts(spark, odd):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    for text, name in ((None, "und"), ("", "und"), ("12 34", "und")):
        one = spark.createDataFrame([(7, text, "en")], "doc_id long, text string, lang string")
        assert language_id.identify(one).first()["lang_pred"] == name
    assert language_id.identify(odd.limit(0)).count() == 0
    assert language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def brute_profile(text):
    """Letter by letter: rotate, multiply, add."""
    letters = [0]
    for c in text or "":
        k = ord(c.lower()[0]) if c.isalpha() else 0
        if k or letters[-1]:
            letters.append(k)
    letters += [0] if letters[-1] else []
    out = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        x, y, z = (language_id.letter(k).astype(int) for k in (a, b, c))
        out += np.roll(x, 2) * np.roll(y, 1) * z
    return out if any(letters) else None


def brute_language(rows):
    """(id, language, cosine) for rows of (id, text, lang)."""
    prototypes = {}
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and brute_profile(text) is not None:
            prototypes[lang] = prototypes.get(lang, 0) + brute_profile(text)
    out = []
    for i, text, _ in rows:
        own = brute_profile(text)
        if own is None or not prototypes:
            out.append((i, "und", 0.0))
            continue
        cosines = {n: float(own @ p / np.linalg.norm(own) / np.linalg.norm(p)) for n, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        out.append((i, best, min(1.0, max(0.0, cosines[best]))))
    return out


@pytest.mark.parametrize("text", ["Abc  de", "naïve ÉLÈVE", "漢字かな交じり文", "привет мир", "\U00010400\U00010428 x", "İi"])
def test_bundle_equals_binding_letter_by_letter(text):
    assert (language_id.bundle(*language_id.trigrams(text)) == brute_profile(text)).all()


def test_predictions_equal_brute_force(spark, sf, odd, monkeypatch):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 400), "lang").limit(60).collect()]
    rows += [(i, t, lang) for i, t, lang in odd.select("doc_id", "text", "lang").collect() if len(t or "") < 1000]
    rows += [(10_000 + k, t * 5, lang) for k, (t, lang) in enumerate([("привет мир как дела ", "ru"), ("γειά σου κόσμε ", "el"), ("世界你好早上好 ", "zh"), ("こんにちは世界 ", "ja")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language_id.identify(docs).collect()]
    expected = [(i, lang, round(c, 6)) for i, lang, c in brute_language(rows)]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert {lang for i, lang, _ in got if i and i >= 10_000} == {"ru", "el", "zh", "ja"}
    with pytest.raises(ValueError):
        language_id.learn(docs, most=2)


def test_accept_keeps_columns_and_drops_what_has_no_language(spark, sf):
    docs = table(spark, sf, "documents")
    more = spark.createDataFrame([(10**9, "12 34 56", "en", "x", 8), (10**9 + 1, None, None, None, None)], docs.schema)
    out = language_id.accept(docs.unionByName(more))
    assert out.columns == docs.columns and out.where("doc_id >= 1000000000").count() == 0 and out.count() > 0.97 * docs.count()


# --- SimHash


def brute_fingerprint(text):
    words = WORDS.findall(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fold_equals_counting_bits():
    for text in (None, "", "one", "one two three four five", "A b C d e F g " * 30, "x " * 7_000, " \n a\tb  c "):
        for block in (7, 1 << 20):
            assert simhash.fold(simhash.shingle_hashes(text or "", block=block)) % (1 << 64) == brute_fingerprint(text)


def components_of(fps, ids, distance):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                label[find(i)] = find(j)
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_of_odd_texts(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    source = odd.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in source]
    expected = components_of(fps, [r["doc_id"] for r in source], 4)
    assert sorted((str(r["doc_id"]), f"{f:016x}", str(c)) for r, f, c in zip(source, fps, expected)) == sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [None, 10, 10**6, 10**11])
def test_links_do_not_depend_on_the_segments(spark, n, monkeypatch):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 12)
    fps = sorted({int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for s in seeds for _ in range(12)})
    if n:
        real = simhash.plan
        monkeypatch.setattr(simhash, "plan", lambda _, d: real(n, d))
    got = {r["node"]: r["component"] for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert [got[f] for f in fps] == components_of(fps, fps, 4)


def test_plans_cover_every_pair():
    for n in (1, 10**4, 10**7, 10**12):
        segments = simhash.plan(n, 4)
        assert len(segments) <= 5 and all(o + w <= 64 for o, w, _ in segments)
        rng = np.random.default_rng(n % 97)
        for _ in range(500):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(bin(diff >> o & ((1 << w) - 1)).count("1") <= r for o, w, r in segments)


@pytest.mark.parametrize("many", [2, 256])
def test_large_families_are_linked_with_all_others(spark, many, monkeypatch):
    """Two families that share segment values, of which one is a key's largest root."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 40, 2) for b in range(1, 40, 2)} | {base ^ (0b1111111 << 50) ^ (1 << k) for k in range(30)}
    fps = sorted(fps)
    real = simhash.apart
    monkeypatch.setattr(simhash, "apart", lambda a, h, n: real(a, h, n, many))
    got = {r["node"]: r["component"] for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert [got[f] for f in fps] == components_of(fps, fps, 4)


# --- fingerprints


def test_fingerprints_of_odd_texts(spark, odd):
    import hashlib

    rows = weighted_fingerprints.fingerprints(odd).collect()
    source = odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    source.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    texts = [r["text"] or "" for r in source]
    expected = []
    for k, t in enumerate(texts):
        half = len(t) // 2
        expected.append((str(source[k]["doc_id"]), len(t), hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 8 * weighted_fingerprints.SAMPLES for r in rows)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (9, 10)}
    assert len(same) == 1
    assert weighted_fingerprints.fingerprints(odd.limit(0)).count() == 0
    one = weighted_fingerprints.fingerprints(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1


def test_samples_agree_as_often_as_weights_overlap(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k:04d}" for k in range(400)]
    pairs = []
    for k in range(60):
        shared, a, b = (list(rng.choice(vocabulary, n)) for n in (60, 30, 30))
        pairs += [(2 * k, " ".join(shared + a)), (2 * k + 1, " ".join(shared + b))]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    rows = weighted_fingerprints.sketch(df, ["doc_id"], 32).collect()
    got = {r["doc_id"]: [r[f"s{k}"] for k in range(32)] for r in rows}
    seen, expected = [], []
    for k in range(60):
        x, y = (Counter(t.split()) for _, t in pairs[2 * k : 2 * k + 2])
        expected.append(sum((x & y).values()) / sum((x | y).values()))
        seen.append(np.mean([a == b for a, b in zip(got[2 * k], got[2 * k + 1])]))
    assert abs(np.mean(seen) - np.mean(expected)) < 0.03


def test_quantiles_are_those_of_the_distribution():
    for p in (0.001, 0.3, 0.5, 0.99):
        x = weighted_fingerprints.gamma_quantile(p)
        assert 1 - (1 + x) * math.exp(-x) == pytest.approx(p)
    mean = np.mean([weighted_fingerprints.gamma_quantile((k + 0.5) / 4096) for k in range(4096)])
    assert mean == pytest.approx(2, abs=0.01)


def likeness(one, two):
    """Generalised Jaccard similarity of two bags of words, a word weighing its count times the square of its length."""
    x, y = (Counter(WORDS.findall(t or "")) for t in (one, two))
    low = sum(min(x[w], y[w]) * len(w) ** 2 for w in x | y)
    return low / sum(max(x[w], y[w]) * len(w) ** 2 for w in x | y) if x | y else 1.0


def test_each_row_tells_its_likeness(spark, sf):
    """near_edited and near_next of each row against the exact similarity, at the number of samples of the registered query."""
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in weighted_fingerprints.fingerprints(docs).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    errors = []
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        for name, other in (("near_edited", text[: len(text) - half] + after[:half]), ("near_next", after)):
            exact = likeness(text, other)
            sigma = math.sqrt(exact * (1 - exact) / weighted_fingerprints.SAMPLES)
            assert abs(rows[i][name] - exact) <= 4.5 * sigma + 0.02
            errors.append(rows[i][name] - exact)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_native_operator_uses_no_python(spark, odd):
    plan = weighted_fingerprints.fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language model


def test_scores(spark, odd):
    rows = lm_scoring.score(odd).collect()
    source = odd.select("doc_id", "text").collect()
    train = [r for r in source if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in WORDS.findall(lower(r["text"])))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    p = lambda c: math.log10((c + 1) / (total + distinct + 1))
    expected = []
    for r in source:
        words = WORDS.findall(lower(r["text"]))
        expected.append((str(r["doc_id"]), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, round(sum(p(counts[w]) for w in words) + p(len(train)), 4)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == sorted(expected)
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in rows)
    assert lm_scoring.score(odd.limit(0)).count() == 0
    none = lm_scoring.score(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert none["score"] == pytest.approx(-3 * math.log10(256)) and none["n_known"] == 0


def brute_score(train, text, depth=lm_scoring.DEPTH):
    counts = {}
    for t in train:
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total, data = 0.0, b"\xff" * depth + text + b"\xff"
    for i in range(depth, len(data)):
        out = set()
        for k in range(depth, -1, -1):
            left = {s: c for s, c in counts.get(data[i - k : i], {}).items() if s not in out}
            if not left:
                continue
            n = sum(left.values())
            if data[i] in left:
                total += math.log10((left[data[i]] - 0.5) / n)
                break
            total += math.log10(len(left) / 2 / n)
            out |= set(left)
        else:
            total += -math.log10(256 - len(out))
    return total


def test_trie_equals_byte_by_byte_coding():
    rng = np.random.default_rng(6)
    train = ["".join(rng.choice(["th", "e ", "er", "x"], 60)).encode() for _ in range(5)]
    for depth in (3, 5):
        codes = lm_scoring.contexts(train, depth)[0]
        full = lm_scoring.summed(codes, np.ones(len(codes), np.int64))
        trie = lm_scoring.Trie(full, lm_scoring.summed(full[0] & 0xFFFFFF, full[1]), depth)
        for text in (b"", b"the", "".join(rng.choice(["th", "e ", "q", "é"], 30)).encode()):
            assert trie.score(lm_scoring.contexts([text], depth)[0]).sum() == pytest.approx(brute_score(train, text, depth), rel=1e-6)


def test_memory_of_the_trie():
    """Beside the counts sent, a worker's trie takes little, and building and asking it no more than a few pieces; bits select a slice."""
    rng = np.random.default_rng(7)
    every = sum((np.arange(11**6) // 11**k % 11 + 97) << (8 * k) for k in range(6))
    full = every[rng.random(len(every)) < 0.6], rng.integers(1, 1000, len(every))
    full = full[0], lm_scoring.narrow(full[1][: len(full[0])])
    short = lm_scoring.summed(full[0] & 0xFFFFFF, full[1])
    asked = rng.choice(every, 2_000_000)
    tracemalloc.start()
    try:
        trie = lm_scoring.Trie(full, short)
        stays, most = tracemalloc.get_traced_memory()
        nodes = sum(len(x[0]) for x in trie.nodes.values()) + sum(len(trie.cells[k][0]) for k in range(5))
        assert stays < 20 * len(full[0]) + 30 * nodes + 1e6 and most < stays + 40e6
        tracemalloc.reset_peak()
        scores = trie.score(asked)
        assert tracemalloc.get_traced_memory()[1] < stays + scores.nbytes + 40e6
    finally:
        tracemalloc.stop()
    inside = rng.random(1 << 24) < 0.5
    assert np.array_equal(trie.score(asked, np.packbits(inside)), np.where(inside[asked >> 8 & 0xFFFFFF], scores, 0.0))


def test_a_worker_builds_a_trie_once(spark):
    """Tasks of one worker share it; it is dropped before counts are gathered again."""
    full = lm_scoring.summed(lm_scoring.contexts([b"some text"])[0], np.ones(10, np.int64))
    shared = spark.sparkContext.broadcast((full, lm_scoring.summed(full[0] & 0xFFFFFF, full[1])))
    ready = cloudpickle.loads(cloudpickle.dumps(lm_scoring._ready))
    assert ready("mark", shared) is ready("mark", shared) is lm_scoring._MODEL["mark"]
    forgotten()
    assert not lm_scoring._MODEL


@pytest.mark.parametrize("part, options", [(None, {}), (2_000, {"block": 700, "frequent": 50})])
def test_scores_equal_brute_force(spark, sf, odd, part, options, monkeypatch):
    """Whole results of the operator, whatever the blocks, slices and frequent words; the session's settings stay as they were."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if part:
        monkeypatch.setattr(lm_scoring, "SLICE", part)
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 300)).limit(40).collect()]
    rows += [(i, t) for i, t in odd.select("doc_id", "text").collect() if len(t or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("own")).withColumn("train", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_scoring.score(docs.repartition(3), **options).collect())
    train = [lower(t).encode() for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    expected = sorted((str(i), n_words(t) + 1, brute_score(train, lower(t).encode())) for i, t in rows)
    for a, b in zip(got, expected, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5)
    assert spark.conf.get(name, None) == before


# --- quality


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    rows = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert all(r["predicted"] == (r["score"] >= 0.3) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_scores_are_sums_of_table_entries(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    wide = docs.withColumn("x", F.lit("own")).withColumn("y", F.lit(1)).withColumn("id", F.lit(2)).withColumn("score", F.lit("s"))
    rows = {r["doc_id"]: r["score"] for r in quality.classify(wide, labels).collect()}
    classes = quality._classes()
    x = {r["doc_id"]: np.array(quality.text_features(r["text"] or "", classes), np.float32).astype(float) for r in docs.collect()}
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in x and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    marks.sort(key=lambda p: (p[0], tuple(x[p[0]])))
    model = quality.fit(np.array([x[i] for i, _ in marks]), np.array([y for _, y in marks], float))
    for i, score in rows.items():
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x[i])]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[a] // model.coarse, bins[b] // model.coarse] for (a, b), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_fit_sees_a_bounded_sample_that_reruns_repeat(spark, sf, monkeypatch):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or real(x, y))
    for frame in (docs, docs.repartition(5)):
        quality.classify(frame, labels, sample=7)
    assert len(seen[0][1]) == 7 and (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()


def test_tables_add_up_and_interactions_are_learned():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, pairs=2)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    assert (0, 1) in model.pairs

"""Near copies of the pipeline's third stage against all pairs."""

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwater.llm import near_copies
from tarnwater.llm.common import table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    """The smallest id of each group that similarities of 0.8 or more connect."""
    ids, sets = zip(*((i, shingles(t)) for i, t in rows))
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s or {None} for j in holders[x] if j < i}:
            if s == sets[j] or Fraction(len(s & sets[j]), len(s | sets[j])) >= Fraction(4, 5):
                label[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted(least.values())


def copies(seed):
    """Originals, their copies with one to eight words replaced (similarities from about 0.6 to 0.98), chains of such, a line that all share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    line, rows = "one line that very many of these texts have in common", []
    for _ in range(60):
        words = [word() for _ in range(rng.randint(6, 220))]
        for step in range(rng.randint(1, 9)):
            text = list(words)
            for _ in range(rng.randint(1, 8) if step else 0):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.randrange(10**9), " ".join(text) + f" {line}" * (len(rows) % 2)))
            if rng.random() < 0.3:
                words = text
    return rows + [(5, None), (6, ""), (7, "  \n"), (8, "a b c"), (9, "A  b c"), (10, "a b d"), (11, "p q r s t"), (12, "p q r s t u")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_equals_all_pairs(spark, seed):
    rows = copies(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.distinct_texts(spark, docs, "").collect())
    assert got == survivors(rows)


def test_stage_equals_all_pairs_on_a_table(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = sorted(r["doc_id"] for r in corpus_pipeline.distinct_texts(spark, docs, "").collect())
    assert got == survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_signatures_tell_near_sets_from_others():
    """Bits that differ: about 15 % at a similarity of 0.8, half between unrelated sets; each segment names its two weakest bits."""
    rng = np.random.default_rng(5)
    width, segments = near_copies.layout(1000)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[100:], rng.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1000 in common
    codes = [near_copies.signature(x, width, segments) for x in (a, b, rng.integers(0, 1 << 63, 900).astype(np.uint64))]
    bits = [((c[:, None] >> np.arange(width)) & 1).ravel() for c in codes]
    assert 0.08 < (bits[0] != bits[1]).mean() < 0.23 and 0.4 < (bits[0] != bits[2]).mean() < 0.6
    ones = np.zeros(width * segments, int)
    for h in a.tolist():
        words = [int(near_copies._words(np.array([h], np.uint64), k)[0]) for k in range(-(-width * segments // 64))]
        ones += [words[i // 64] >> i % 64 & 1 for i in range(width * segments)]
    assert (bits[0] == (2 * ones > len(a))).all()
    lead = np.abs(2 * ones - len(a)).reshape(segments, width)
    places = np.stack([codes[0] >> 32 & 255, codes[0] >> 40 & 255], axis=1)
    assert (np.take_along_axis(lead, places, 1) == np.sort(lead, axis=1)[:, :2]).all()


@pytest.mark.parametrize("width", sorted(near_copies.AGREE))
def test_share_of_pairs_that_meet(width):
    """The stated share of segments that agree but for the weakest bits, by simulation; the plan's chance of a miss follows from it."""
    rng, n = np.random.default_rng(width), 60_000
    cosine = 2 * 0.8 / 1.8
    x = rng.standard_normal((n, width))
    y = cosine * x + np.sqrt(1 - cosine**2) * rng.standard_normal((n, width))
    apart = (x > 0) != (y > 0)
    strong = np.argsort(np.abs(x), axis=1)[:, 2:]
    share = (~np.take_along_axis(apart, strong, 1).any(axis=1)).mean()
    assert share == pytest.approx(near_copies.AGREE[width], rel=0.12)
    segments = next(near_copies.layout(1 << k)[1] for k in range(8, 40) if near_copies.layout(1 << k)[0] == width)
    assert (1 - share) ** segments < 2 * near_copies.MISS


@pytest.mark.parametrize("crowded", [2, 16])
def test_family_of_which_many_are_not_near_enough(spark, crowded, monkeypatch):
    """150 copies of one text with a tenth of its words replaced: some similarities of 0.8 and more, most a little below."""
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    rng = random.Random(9)
    words = ["w%d" % rng.randrange(4000) for _ in range(160)]
    rows = []
    for k in range(150):
        text = list(words)
        for _ in range(rng.randint(1, 7)):
            text[rng.randrange(len(text))] = "x%d" % rng.randrange(10**6)
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    expected = survivors(rows)
    assert 1 < len(expected) < 140
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect()) == expected


def test_stage_keeps_columns_of_any_name(spark, odd):
    extra = odd
    for name in ("k1", "k2", "_k1", "root", "node", "key", "n", "_key", "component_id", "text_"):
        extra = extra.withColumn(name, F.lit("mine"))
    out = near_copies.one_of_each(extra).collect()
    assert near_copies.one_of_each(odd).count() == len(out) and all(r[c] == "mine" for r in out for c in ("k1", "_k1", "root", "_key"))
    assert near_copies.one_of_each(odd.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 64])
def test_marks_only_spare_work(spark, cells):
    rows = copies(4)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs, cells=cells).collect()) == survivors(rows)

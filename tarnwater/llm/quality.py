"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Features of a text are counts and shares that any length has. Each is cut into bins at quantiles; boosting goes round the
features and adds to one feature's table the few leaves of a small tree on its bins, then does the same for the pairs whose
interaction explains most of what is left. A score is the logistic of the sum of table entries.

The tables are learned by the driver from at most `sample` labelled rows (a documented bound, drawn by a hash of the id); features
and scores are computed over all rows, whole texts, where they are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kept, released, stored

FEATURES = ["chars", "words", "word_length", "upper", "digits", "symbols", "stops", "exclamations", "bars", "distinct_words", "top_word", "repeated_word", "repeated_lines", "line_length", "beyond_ascii", "entropy", "longest_word", "wordless", "open_lines", "distinct_pairs"]


def _classes() -> np.ndarray:
    out = np.zeros((256, 7))
    for k, of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*|{}<>@~^_=+\\/[]", b".,;:!?'\"-()", b"!", b"|", bytes(range(128, 256)))):
        out[list(of), k] = 1
    return out


def text_features(text: str, classes: np.ndarray) -> list[float]:
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data) or 1
    upper, digits, symbols, stops, exclamations, bars, beyond = (counts @ classes / n).tolist()
    letters = (counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) or 1
    p = counts[counts > 0] / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    seen, m, k = Counter(words), len(words) or 1, len(lines) or 1
    letterless = sum(c for w, c in seen.items() if not any(b >= 65 for b in w))
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / m, upper * n / letters, digits, symbols, stops, exclamations, bars,
        len(seen) / m, max(seen.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, 1 - len(set(lines)) / k, np.log1p(len(data) / k), beyond,
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0, np.log1p(max(map(len, seen), default=0)), letterless / m,
        sum(not x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / k, len(set(zip(words, words[1:]))) / m,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) for each row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        classes = _classes()
        for batch in blocks(batches, "text"):
            rows = [text_features(t or "", classes) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.array(rows, np.float32).ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, flat)], ["id", "x"])
        released()

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


@dataclass
class Additive:
    """Bin edges, tables by feature and by pair, and the intercept."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            total += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A tree of a few leaves on one feature's histogram, best split first: its value in each bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))

    def best(a: int, b: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0.0, a
        gain = _gain(cg[:-1], ch[:-1], ridge) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge) - _gain(cg[-1], ch[-1], ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(parts) < leaves:
        gain, cut, part = max((*best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of depth two on a pair's grid, split on the first feature and then on the second in each half: values and gain."""
    best, out = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(gg)):
            value, total = np.zeros_like(gg), -_gain(gg.sum(), hh.sum(), ridge)
            for half in (slice(0, cut), slice(cut, None)):
                leaf = _tree(gg[half].sum(axis=0), hh[half].sum(axis=0), ridge, 2)
                value[half] = leaf
                total += float((leaf * (gg[half].sum(axis=0))).sum())
            if total > best:
                best, out = total, value if axis == 0 else value.T
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 5, pair_rounds: int = 30, ridge: float = 2.0) -> Additive:
    """Learn from rows x and labels y of 0 and 1. Without rows every score is 0.5; with one class only it is near that class."""
    model = Additive(coarse=max(1, bins // 8))
    if not len(y):
        return model
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b, total = model.bins(x), np.full(len(y), model.base)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    for _ in range(rounds):
        for j, n in enumerate(sizes):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, j], y - p, n), np.bincount(b[:, j], p * (1 - p), n), ridge)
            model.tables[j] += step
            total += step[b[:, j]]
    c = b // model.coarse
    grid = lambda i, j, v: np.bincount(c[:, i] * 64 + c[:, j], v, 4096).reshape(64, 64)[: c[:, i].max() + 1, : c[:, j].max() + 1]
    p = 1 / (1 + np.exp(-total))
    found = sorted(((-_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), ridge)[1], i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes))))[:pairs]
    for gain, i, j in found:
        if gain < 0:
            model.pairs[i, j] = np.zeros((sizes[i] // model.coarse + 1, sizes[j] // model.coarse + 1))
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), ridge)[0]
            t[: step.shape[0], : step.shape[1]] += step
            total += step[c[:, i], c[:, j]]
    return model


def learn(known: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 5, label_id: str = "doc_id", label_col: str = "quality") -> Additive:
    """Fit on features (id, x) of labelled rows, of more than `sample` the first by a hash of the id.

    Of labels that repeat an id the mean decides, 1 on ties; null labels are none.
    """
    marks = labels.select(F.col(label_id).alias("of"), F.col(label_col).alias("y")).where("of is not null and y is not null")
    marks = marks.groupBy("of").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    train = known.join(marks, known["id"] == marks["of"]).select("id", "x", "y")
    first = train.orderBy(F.xxhash64("id", F.lit(seed)), "id", "x").limit(sample)
    rows = sorted((r["id"], tuple(r["x"]), r["y"]) for r in first.collect())
    return fit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r[2] for r in rows], np.float64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`.

    Learns from labelled rows whose crc32(id as text) mod 5 is not 0; a null id is neither held out nor learned from. Empty and
    null texts are scored like others, equal texts alike. Repeated rows give repeated rows, an empty table none; without labelled
    rows each score is 0.5. `sample` bounds the labelled rows that the fit sees. A text is taken whole: its words and pairs of
    neighbouring words are counted in memory, some hundred bytes for each distinct one. Other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = stored(features(docs, id_col, text_col), "features")
    fold = F.crc32(F.col("id").cast("string")) % 5
    model = learn(known.where(fold != 0), labels, sample)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    scored = known.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with score >= threshold, all columns. Features, not texts, are joined with the labels."""
    known = stored(features(docs.where(F.crc32(docs[id_col].cast("string")) % 5 != 0), id_col, text_col), "features")
    model = learn(known, labels, sample)

    def decide(texts):
        classes = _classes()
        return (model.score(np.array([text_features(t or "", classes) for t in texts], np.float32).astype(np.float64).reshape(len(texts), -1)) >= threshold).tolist()

    return kept(docs, decide, text_col)

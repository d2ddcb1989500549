"""Language identification with hyperdimensional letter-trigram profiles.

Each letter has a random vector of +1 and -1. A trigram is its letters' vectors, rotated by their place and multiplied (bound); a
profile is the sum (bundle) of its trigrams' vectors. A language's prototype is the profile of all its training texts, a
document's language the one whose prototype has the largest cosine with the document's profile.

Letters are folded to lower case. Each letter of Unicode has a vector of its own, drawn from its code point; everything else is one gap
between words, with a vector too. Trigrams are counted first and bound once per distinct one. Training emits one integer vector per
language and task, so its shuffle doesn't grow with the texts; sums of integers don't depend on their order. The driver holds
languages x dimensions numbers; a table with more than `LANGUAGES` distinct labels is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, blocks, kept, released

DIMENSIONS, SEED, UNKNOWN, LANGUAGES = 1024, 11, "und", 10_000
#: Bound vectors and letters that a Python worker keeps ready, a byte per dimension each; others are made when they are met.
READY, LETTERS = 16_384, 8_192
#: Trigrams that training gathers of a language before it bundles them.
PENDING = 1 << 20
PART = (1 << 21) - 1
_KEPT: dict = {}
MEMOS.append(_KEPT)


def _state() -> dict:
    if not _KEPT:
        kind = np.zeros(0x10000, np.int64)
        for c in range(0x10000):
            if chr(c).isalpha():
                kind[c] = ord(chr(c).lower()[0])
        _KEPT.update(kind=kind, letters={}, slot={}, ready=np.zeros((READY, DIMENSIONS), np.int8))
    return _KEPT


def letter(code_point: int) -> np.ndarray:
    """The vector of a letter, or of the gap (0)."""
    known = _state()["letters"]
    if code_point in known:
        return known[code_point]
    own = np.random.default_rng([SEED, code_point]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)
    if len(known) < LETTERS:
        known[code_point] = own
    return own


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes (21 bits a letter) and their counts; none if the text has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _state()["kind"][np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]).tolist():
        codes[points == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def _bind(codes: np.ndarray) -> np.ndarray:
    """Letters' vectors, rotated by their place and multiplied."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        found, at = np.unique(codes >> shift & PART, return_inverse=True)
        out *= np.stack([np.roll(letter(c), turn) for c in found.tolist()])[at]
    return out


def _bound(codes: np.ndarray) -> np.ndarray:
    """The trigrams' vectors; those met first stay ready in the worker."""
    t = _state()
    slot, ready = t["slot"], t["ready"]
    at = np.fromiter((slot.get(c, -1) for c in codes.tolist()), np.int64, len(codes))
    new = np.flatnonzero(at < 0)
    if not len(new):
        return ready[at]
    vectors, used = _bind(codes[new]), len(slot)
    n = min(len(new), READY - used)
    ready[used : used + n] = vectors[:n]
    slot.update(zip(codes[new[:n]].tolist(), range(used, used + n)))
    out = ready[np.maximum(at, 0)]
    out[new] = vectors
    return out


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The profile: bound vectors of the trigrams, weighed by their counts. Exact below 2**24 trigrams, in double precision beyond."""
    out, kind = np.zeros(DIMENSIONS, np.float64), np.float32 if counts.sum() < 1 << 24 else np.float64
    for k in range(0, len(codes), 2048):
        out += counts[k : k + 2048].astype(kind) @ _bound(codes[k : k + 2048]).astype(kind)
    return out


def learn(texts: DataFrame, most_at_once: int = 32, most: int = LANGUAGES) -> dict[str, np.ndarray]:
    """language -> prototype, from all rows of `texts` (text, lang); rows with a null in either, or without a letter, teach nothing."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        pending: dict[str, list] = {}
        waiting = 0

        def settle():
            for name, parts in pending.items():
                codes, counts = (np.concatenate(x) for x in zip(*parts))
                found, back = np.unique(codes, return_inverse=True)
                profile = bundle(found, np.bincount(back, counts).astype(np.int64))
                sums[name] = sums.get(name, 0) + np.rint(profile).astype(np.int64)
            pending.clear()

        def out():
            names = sorted(sums)
            vectors = pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), vectors], ["lang", "vector"])

        for batch in blocks(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes, counts = trigrams(text)
                if not len(codes):
                    continue
                pending.setdefault(lang, []).append((codes, counts))
                waiting += len(codes)
                if waiting > PENDING:
                    settle()
                    waiting = 0
                if len(sums.keys() | pending.keys()) > most_at_once:
                    settle()
                    waiting = 0
                    yield out()
        settle()
        if sums:
            yield out()
        released()

    parts = texts.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    totals = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = totals.limit(most * DIMENSIONS + 1).collect()
    if len(rows) > most * DIMENSIONS:
        raise ValueError(f"over {most} languages; labels of this kind aren't languages")
    out: dict[str, np.ndarray] = {}
    for row in rows:
        out.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["i"]] = row["x"]
    return {k: out[k] for k in sorted(out)}


def training_row(id_col: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != fold, F.lit(False))


def nearest(text: str | None, names: list[str], unit: np.ndarray) -> tuple[str, float]:
    """A text's language and cosine."""
    codes, counts = trigrams(text or "")
    if not len(codes) or not names:
        return UNKNOWN, 0.0
    profile = bundle(codes, counts)
    cosines = unit @ profile / (np.linalg.norm(profile) or 1)
    best = int(np.argmax(cosines))
    return names[best], float(min(1.0, max(0.0, cosines[best])))


def scaled(prototypes: dict[str, np.ndarray]) -> np.ndarray:
    return np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()])


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the nearest prototype and the cosine, at least 0. Null texts, texts without a letter, and all texts without a prototype, are `und` with score 0. Ties go to the first language by name."""
    kind, names, unit = docs.schema[id_col].dataType.simpleString(), list(prototypes), scaled(prototypes)

    def run(batches):
        for batch in blocks(batches, "text"):
            found = [nearest(t, names, unit) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])
        released()

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(training_row(docs[id_col])).select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))


def accept(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose text is in a known language, all columns.

    Rejected are `und` texts and those whose cosine is below least * n / (n + 400) for n characters: short texts can't come near
    a prototype, long ones in a language do. An input that teaches no language is passed whole but for `und` by letters alone.
    """
    prototypes = learn(_training(docs, id_col, text_col, lang_col))
    names, unit = list(prototypes), scaled(prototypes)

    def decide(texts):
        if not names:
            return [len(trigrams(t or "")[0]) > 0 for t in texts]
        found = [nearest(t, names, unit) for t in texts]
        return [lang != UNKNOWN and score >= least * len(t) / (len(t) + 400) for t, (lang, score) in zip(texts, found)]

    return kept(docs, decide, text_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of `docs`.

    Learns from rows whose crc32(id as text) mod 3 is not 1 and whose language is known; a null id is neither held out nor
    learned from. Predictions see the text alone. Repeated rows give repeated rows, an empty table none; other columns are not
    read. Equal cosines go to the first language by name. A text is taken whole, some tens of bytes a character while it is counted.
    """
    scored = predict(docs, learn(_training(docs, id_col, text_col, lang_col)), id_col, text_col)
    return scored.select(id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

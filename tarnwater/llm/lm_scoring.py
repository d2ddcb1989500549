"""Language-model scores: prediction by partial matching over bytes, beside a unigram word baseline.

The model is a byte-context trie of depth `DEPTH`, learned from all training texts. A byte is predicted from the longest context
that was seen; where it wasn't seen behind that, the coder escapes to the context one byte shorter, down to all bytes alike.
Escapes are estimated by method D (half a count for each distinct successor), and symbols that a longer context has seen are
excluded from the shorter ones, so the probabilities behind each context add up to one. A text begins behind 0xFF bytes and ends
with one, which UTF-8 doesn't use otherwise.

Only counts of full-depth contexts are gathered; shorter ones are their sums. The trie grows with the training texts, so it is
cut into slices by the last three bytes of the context: a prediction's contexts of three bytes and more all lie in one slice,
shorter ones (at most 2**24 counts, whatever is read) are in each. The number of slices follows from the number of counts, one slice
is broadcast and scored at a time, and a text's score is the sum over slices. One slice holds about `SLICE` counts, and
can't hold more than that and 2**24 with depth five.

Each Python worker holds the slice's trie: some 35 bytes a count. The driver sends sorted counts, which the trie keeps as its own
deepest level; it is built, and asked, for `PIECE` counts at a time, so neither takes much more than what stays.

Words for the baseline have no such bound. Their counts are summed before the shuffle and stay a distributed table. Words
too frequent to be joined cheaply, of which there are `frequent` at most, are broadcast and looked up where the text is read, so
they never form hot keys; only the rarer words of each text are joined to the table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, batches_of, blocks, forgotten, released, stored

DEPTH, SLICE, GATHERED, EDGE, PIECE = 5, 4_000_000, 1_000_000, b"\xff", 1 << 17
_MODEL: dict[str, Trie] = {}
MEMOS.append(_MODEL)


def contexts(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes (`depth` preceding bytes and the byte, as one integer) of all predictions, and where each text's codes end."""
    data = np.frombuffer(b"".join(x for t in texts for x in (EDGE * depth, t, EDGE)), np.uint8)
    sizes = np.array([len(t) + depth + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(data), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    code, shifted = data.astype(np.int64), np.empty(len(data), np.int64)
    for k in range(1, depth + 1):
        code[k:] |= np.left_shift(data[:-k], 8 * k, out=shifted[k:], dtype=np.int64)
    del shifted
    return code[keep], np.cumsum(sizes - depth)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts; what is that already is returned as it is."""
    if (codes[1:] > codes[:-1]).all():
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = _changes(codes, 0)
    return codes[first], np.add.reduceat(counts, first, dtype=np.int64)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they all fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


def _changes(codes: np.ndarray, shift: int) -> np.ndarray:
    """Where runs of equal codes, but for their last `shift` bits, begin."""
    new = np.ones(len(codes), bool)
    for a in range(1, len(codes), PIECE):
        b = min(a + PIECE, len(codes))
        new[a:b] = codes[a:b] >> shift != codes[a - 1 : b - 1] >> shift
    return np.flatnonzero(new)


def _shortened(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts behind contexts of `depth` bytes, of counts behind longer ones."""
    out, mask, most = (np.zeros(0, np.int64), np.zeros(0, np.int64)), (1 << (8 * (depth + 1))) - 1, 4 * PIECE
    for a in range(0, len(codes), most):
        out = summed(np.concatenate([out[0], codes[a : a + most] & mask]), np.concatenate([out[1], counts[a : a + most]]))
    return out


class Trie:
    """Counts by context and symbol at each depth, ready for scoring.

    A context's node has n and d, total and number of its successors, and what excluding them leaves of the next shorter
    context: m and e. Seen symbols have (c - 1/2) / n, escapes d / 2n; behind an escape the shorter context is read with m and
    e instead.
    """

    def __init__(self, full: tuple[np.ndarray, np.ndarray], short: tuple[np.ndarray, np.ndarray], depth: int = DEPTH, least: int = 3):
        """full: codes of `depth` bytes and the symbol, with counts, of this slice; short: of least - 1 bytes and the symbol, of all."""
        self.depth, self.cells, self.nodes = depth, {}, {}
        now = summed(*full)
        for k in range(depth, -1, -1):
            if k == min(least - 1, depth):
                now = summed(*short)
            self.cells[k] = now
            now = _shortened(*now, k - 1) if k else now
        for k in range(depth + 1):
            codes, counts = self.cells[k]
            first = _changes(codes, 8)
            n = np.add.reduceat(counts, first, dtype=np.float64) if len(first) else np.zeros(0)
            ends = np.append(first, len(codes))
            own, d = codes[first] >> 8, np.diff(ends).astype(np.int16)
            m, e = np.zeros(len(first)), np.zeros(len(first), np.int16)
            for a in range(0, len(first) if k else 0, PIECE):
                b = min(a + PIECE, len(first))
                at = np.searchsorted(self.nodes[k - 1][0], own[a:b] & ((1 << (8 * (k - 1))) - 1))
                there = np.searchsorted(self.cells[k - 1][0], codes[ends[a] : ends[b]] & ((1 << (8 * k)) - 1))
                gone = np.add.reduceat(self.cells[k - 1][1][there], first[a:b] - first[a], dtype=np.int64)
                m[a:b], e[a:b] = self.nodes[k - 1][1][at] - gone, self.nodes[k - 1][2][at] - d[a:b]
            self.nodes[k] = (own, n, d, m, e)
        self._hash()

    def _hash(self) -> None:
        """Open addressing over the places of the full-depth cells: nearly all predictions end there."""
        codes, counts = self.cells[self.depth]
        own, n, _, _, _ = self.nodes[self.depth]
        self.bits = max(4, int(np.ceil(np.log2(2 * len(codes) + 1))))
        self.places, self.values = np.full(1 << self.bits, -1, np.int32), np.zeros(len(codes), np.float32)
        for a in range(0, len(codes), PIECE):
            part = codes[a : a + PIECE]
            self.values[a : a + PIECE] = np.log10(counts[a : a + PIECE] - 0.5) - np.log10(n[np.searchsorted(own, part >> 8)])
            todo, slot = np.arange(a, a + len(part)), self._slot(part)
            while len(todo):
                free = self.places[slot] < 0
                self.places[slot[free]] = todo[free]
                lost = self.places[slot] != todo
                todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, codes: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each prediction; with `inside`, a bit for each three bytes, 0 for contexts whose last three have none."""
        out = np.zeros(len(codes))
        for a in range(0, len(codes), PIECE):
            part = codes[a : a + PIECE]
            if inside is None:
                out[a : a + PIECE] = self._score(part)
                continue
            last = part >> 8 & 0xFFFFFF
            here = np.flatnonzero(inside[last >> 3] >> (7 - (last & 7)).astype(np.uint8) & 1)
            out[a + here] = self._score(part[here])
        return out

    def _score(self, codes: np.ndarray) -> np.ndarray:
        known = self.cells[self.depth][0]
        if not len(known):
            return self._escape(codes)
        slot = self._slot(codes)
        place = self.places[slot]
        hit = (known[place] == codes) & (place >= 0)
        out = self.values[place].astype(np.float64)
        todo, lost = np.flatnonzero(~hit), []
        place, at = place[todo], slot[todo]
        while len(todo):
            lost.append(todo[place < 0])
            todo, at = todo[place >= 0], (at[place >= 0] + 1) & ((1 << self.bits) - 1)
            place = self.places[at]
            hit = (known[place] == codes[todo]) & (place >= 0)
            out[todo[hit]] = self.values[place[hit]]
            todo, at, place = todo[~hit], at[~hit], place[~hit]
        if lost and len(rest := np.concatenate(lost)):
            distinct, back = np.unique(codes[rest], return_inverse=True)
            out[rest] = self._escape(distinct)[back]
        return out

    def _escape(self, codes: np.ndarray) -> np.ndarray:
        out, fresh = np.zeros(len(codes)), np.ones(len(codes), bool)
        n, d, todo = np.zeros(len(codes)), np.zeros(len(codes)), np.arange(len(codes))
        for k in range(self.depth, -1, -1):
            if not len(todo):
                return out
            code = codes[todo] & ((1 << (8 * (k + 1))) - 1)
            nodes, cells = self.nodes[k], self.cells[k]
            if not len(nodes[0]):
                continue
            at = np.minimum(np.searchsorted(nodes[0], code >> 8), len(nodes[0]) - 1)
            known = nodes[0][at] == code >> 8
            n[todo], d[todo] = np.where(fresh[todo], nodes[1][at], n[todo]), np.where(fresh[todo], nodes[2][at], d[todo])
            there = np.minimum(np.searchsorted(cells[0], code), len(cells[0]) - 1)
            seen = known & (cells[0][there] == code)
            total = np.maximum(n[todo], 1)
            out[todo] += np.where(seen, np.log10(cells[1][there] - 0.5) - np.log10(total), np.where(known & (d[todo] > 0), np.log10(np.maximum(d[todo], 1) / 2) - np.log10(total), 0.0))
            fresh[todo[known]] = False
            n[todo], d[todo] = np.where(known, nodes[3][at], n[todo]), np.where(known, nodes[4][at], d[todo])
            todo = todo[~seen]
        out[todo] -= np.log10(max(1, 256 - len(self.cells[0][0])))
        return out


def _ready(mark: str, shared: Broadcast) -> Trie:
    """The marked trie, built once in each worker: a nested function would bring a copy of _MODEL with every task."""
    if mark not in _MODEL:
        forgotten()
        _MODEL[mark] = Trie(*shared.value)
        released()
    return _MODEL[mark]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, dictionary and place in it of each word of lower-cased texts."""
    split = pc.ascii_split_whitespace(texts)
    words, rows = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(words, "")
    coded = words.filter(full).dictionary_encode()
    return rows.filter(full).to_numpy(zero_copy_only=False), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _lower(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(batch.column("text"), "").cast(pa.string()))


def _fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 7


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 300_000, block: int = 1 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Learns from rows whose crc32(id as text) mod 7 is not 2; a null id is neither held out nor learned from. A null text counts
    as empty and has one token, its end. Without training rows each byte costs log10(1/256). Repeated rows give repeated rows with
    equal scores, an empty table none. Both scores are log10 probabilities of the text with A-Z lower-cased. A text is taken whole,
    with some tens of bytes a character while it is scored. Other columns are not read.
    """
    with batches_of(docs.sparkSession, 1000):
        return _score(docs, id_col, text_col, frequent, block)


def _score(docs: DataFrame, id_col: str, text_col: str, frequent: int, block: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def gather(batches):
        forgotten()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            codes, counts = summed(*(np.concatenate(x) for x in zip(*kept)))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["word", "code", "n"])

        for batch in blocks(batches, "text", block):
            texts = _lower(batch)
            _, words, at = _words(texts)
            kept.append(np.unique(contexts([t.encode() for t in texts.to_pylist()])[0], return_counts=True))
            yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), pa.array(np.bincount(at, minlength=len(words)))], ["word", "code", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([batch.num_rows], pa.int64())], ["word", "code", "n"])
            if sum(len(x[0]) for x in kept) > GATHERED:
                yield out()
        if kept:
            yield out()
        released()

    def sent(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes and their counts, as workers get them."""
        part = part.toArrow()
        codes, counts = summed(part.column("code").to_numpy(), part.column("n").to_numpy())
        return codes, narrow(counts)

    counted = stored(rows.where(_fold(F.col("id")) != 2).mapInArrow(gather, "word string, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    cells, words = counted.where("code is not null").select("code", "n"), counted.where("word is not null").select("word", "n")
    ends = int((counted.where("word is null and code is null").agg(F.sum("n")).first()[0]) or 0)
    sizes = sorted(((r["k"], r["words"], r["n"]) for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    total, distinct = sum(x[2] for x in sizes) + ends, sum(x[1] for x in sizes) + (ends > 0)
    least, held = 1 << 62, 0
    for k, n, _ in sizes:
        if held + n > frequent:
            break
        least, held = 1 << k, held + n
    common = words.where(F.col("n") >= least).toArrow()
    known_words = spark.sparkContext.broadcast((common.column("word").combine_chunks(), common.column("n").to_numpy()))
    short = sent(cells.groupBy((F.col("code").bitwiseAND(F.lit(0xFFFFFF))).alias("code")).agg(F.sum("n").alias("n")))
    slices = max(1, -(-cells.count() // SLICE))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    if slices > 1:
        numbered = stored(numbered, "texts")

    def slice_of(code):
        return F.pmod(F.xxhash64(F.shiftright(code, 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(slices))

    def scored(number: int) -> DataFrame:
        """Of each row its score by the slice's contexts; with the first slice also its words."""
        shared = spark.sparkContext.broadcast((sent(cells.where(slice_of(F.col("code")) == number) if slices > 1 else cells), short))
        # which of all last three bytes belong to the slice: a bit each
        mine = None
        if slices > 1:
            keys = spark.range(1 << 24).where(F.pmod(F.xxhash64("id"), F.lit(slices)) == number).toArrow().column("id").to_numpy()
            bits = np.zeros(1 << 24, bool)
            bits[keys] = True
            mine = spark.sparkContext.broadcast(np.packbits(bits))
            del keys, bits
        released()
        mark = uuid.uuid4().hex

        def evaluate(batches):
            trie = _ready(mark, shared)
            known, times = known_words.value if not number else (None, np.zeros(0))
            worth = np.log10(times + 1.0)
            for batch in blocks(batches, "text", block):
                texts, n = _lower(batch), batch.num_rows
                code, upto = contexts([t.encode() for t in texts.to_pylist()])
                gains = trie.score(code, None if mine is None else mine.value)
                sums = pa.array(np.add.reduceat(gains, np.concatenate([[0], upto[:-1]])))
                if number:
                    yield pa.RecordBatch.from_arrays([batch.column("row"), sums], ["row", "score"])
                    continue
                row, found, at = _words(texts)
                place = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False) if len(known) else np.full(len(found), -1)
                value = np.append(worth, 0.0)[place]
                tokens = np.bincount(row, minlength=n)
                base, sure = np.bincount(row, value[at], n).astype(np.float64), np.bincount(row, (place >= 0)[at], n).astype(np.int64)
                rare, width = place[at] < 0, max(len(found), 1)
                pair, times_in = np.unique(row[rare].astype(np.int64) * width + at[rare], return_counts=True)
                ends_rare = np.cumsum([0, *np.bincount(pair // width, minlength=n)]).astype(np.int32)
                listed = pa.StructArray.from_arrays([found.take(pa.array(pair % width)), pa.array(times_in.astype(np.int32))], ["word", "n"])
                yield pa.RecordBatch.from_arrays([batch.column("row"), sums, batch.column("id"), pa.array(tokens), pa.array(sure), pa.array(base), pa.ListArray.from_arrays(pa.array(ends_rare), listed)], ["row", "score", "id", "words", "sure", "base", "rare"])
            released()

        more = f", id {kind}, words long, sure long, base double, rare array<struct<word: string, n: int>>" if not number else ""
        done = stored(numbered.mapInArrow(evaluate, f"row long, score double{more}"), "parts")
        for table in (shared, mine):
            if table is not None:
                table.destroy()
        return done

    parts = scored(0)
    others = [scored(k) for k in range(1, slices)]
    known_words.destroy()
    rare = parts.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("times"))
    joined = rare.join(words.where(F.col("n") < least), "word")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more"), F.sum("times").alias("also"))
    out = parts.drop("rare").join(sums, "row", "left")
    for k, other in enumerate(others):
        out = out.join(other.withColumnRenamed("score", f"score{k}"), "row").withColumn("score", F.col("score") + F.col(f"score{k}")).drop(f"score{k}")
    tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - tokens * F.lit(float(np.log10(total + distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(_fold(F.col("id")) == 2, F.lit(False)).alias("held_out"), tokens.cast("long").alias("n_tokens"),
        (F.col("sure") + F.coalesce("also", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )

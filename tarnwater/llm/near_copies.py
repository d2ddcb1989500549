"""One document of each group of near copies: SimHash of five-word shingles, multi-index hashing, an exact check of what it finds.

A text's set of shingles has a fingerprint wide enough for a Jaccard similarity of 0.8: at that similarity two fingerprints differ
in about 15 % of their bits, and sets of unrelated texts in half of them. The bits are cut into segments, and a table of segment
values is asked for each segment's small Hamming ball. Of a ball only the part that near copies land in is enumerated: a segment's
two weakest bits, those whose counts of ones and zeros are closest, are flipped or not. Matches have their complete distance
verified, and what is left its exact similarity, from the texts.

A pair at a similarity of exactly 0.8 is missed with a probability of about `MISS`, by the normal model of the counts, and much more
rarely above; a pair below 0.8 is never linked. Sets that may be similar enough are within a factor of 0.8 in size, so keys tell size
classes too, which thins out chance matches by an order of magnitude.

Large groups would still be compared pair by pair. So a first, linear round compares each set with one other of its bucket in each
segment only, the three nearest of which are checked; the full search then compares sets of different groups of that round, and a
bucket's largest group isn't compared with itself. Links left out join sets which are connected already. Many sets that are
somewhat alike, but not enough, would meet in crowded buckets again and again: there 512 parity bits of the sets, which bound the
similarity from above, are compared inside the join. Rows carry the values of the first segments (eight of 16 bits), whose distance is
verified there too; two sets that agree in one of these aren't listed again by later segments.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, blocks, dropped, forgotten, fresh, heap_returned, released, stored
from .components import components
from .simhash import apart, shingle_hashes

SIZE = 5
#: The similarity from which sets are linked, as a fraction.
OVER, UNDER = 4, 5
#: Chance of missing a pair at just that similarity.
MISS = 0.005
#: Share of segments of a width that agree but for the two weakest bits, at a similarity of 0.8 (simulated, normal model).
AGREE = {16: 0.197, 20: 0.106, 24: 0.057, 28: 0.031}
#: Share of bits that may differ, of a whole fingerprint, of its first 64 and its first 128 bits: about four deviations or more beyond
#: what 0.8 leads to.
FAR, FAR_FIRST, FAR_BOTH = 0.25, 21, 38
#: Longs of parity bits, and the sets in a bucket from which on it is crowded.
LONGS, CROWDED = 8, 4
#: Sets that the first round checks of those that a set meets.
NEAREST = 3
#: Orders by which the sets of the first round are chosen.
ORDERS = 32


def layout(n: int) -> tuple[int, int]:
    """(width, segments) for n sets: wider segments as n grows, so that chance matches per set stay bounded."""
    width = next((w for w in AGREE if n <= 1 << (w + 4)), max(AGREE))
    return width, math.ceil(math.log(MISS) / math.log1p(-AGREE[width]))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; none for null, empty and blank ones."""
    parts = [np.array(part, np.uint64) for part in shingle_hashes(text or "", size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _words(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits derived from each hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray, width: int, segments: int, block: int = 1 << 14) -> np.ndarray:
    """A long for each segment: its bits, and from bits 32 and 40 on the places of its weakest and second weakest bit."""
    bits = width * segments
    longs = -(-bits // 64)
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        data = np.stack([_words(part, k) for k in range(longs)], axis=1)
        ones += np.unpackbits(data.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    lead = (2 * ones[:bits] - len(hashes)).reshape(segments, width)
    value = (lead > 0) @ (1 << np.arange(width, dtype=np.int64))
    weak = np.argsort(np.abs(lead), axis=1, kind="stable")[:, :2].astype(np.int64)
    return value | weak[:, 0] << 32 | weak[:, 1] << 40


def parities(sets: list[np.ndarray]) -> pa.Array:
    """For each set, whether each of its hashes' 512 classes has an odd number of them: two sets differ in at most as many of these bits as shingles."""
    size = 64 * LONGS
    odd = [np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 for s in sets]
    packed = np.packbits(np.array(odd, np.uint8).reshape(-1, size), axis=1, bitorder="little").view("<i8").ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(packed) + 1, LONGS, dtype=np.int32)), pa.array(packed))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, segments: int) -> DataFrame:
    """(id, k1, k2, s1, s2, n, code, odd) for each row: keys of the row and of its set, the set's size, signature and parity bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        forgotten()
        for batch in blocks(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            codes = np.concatenate([signature(s, width, segments) for s in sets])
            ends = pa.array(np.arange(0, len(codes) + 1, segments, dtype=np.int32))
            columns = [batch.column(c) for c in ("id", "k1", "k2")]
            columns += [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.ListArray.from_arrays(ends, pa.array(codes)), parities(sets)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", "s1", "s2", "n", "code", "odd"])
        released()

    rows = docs.select(docs[id_col].alias("id"), *row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, s1 long, s2 long, n long, code array<long>, odd array<long>")


def row_key(docs: DataFrame, *columns: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by these columns."""
    held = [docs[c] for c in columns]
    return F.xxhash64(*held).alias("k1"), F.xxhash64(F.lit(1), *reversed(held)).alias("k2")


def _marks(keys: DataFrame, cells: int) -> np.ndarray:
    """A bit for each of the `cells` that a key falls in: of constant size, whatever is read."""
    marks = np.zeros(cells, bool)
    marks[keys.select(F.pmod("k1", F.lit(cells)).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()] = True
    return np.packbits(marks)


def _marked(rows: DataFrame, held, cells: int, column: str, wanted: bool = True) -> DataFrame:
    """The rows whose key falls in a marked cell, or in none. No shuffle; only keys go to Python, not the texts beside them."""

    @F.arrow_udf("boolean")
    def inside(keys: pa.Array) -> pa.Array:
        at = keys.to_numpy(zero_copy_only=False) % cells
        return pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) == wanted)

    return rows.where(inside(column))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, cells: int) -> DataFrame:
    """The rows of `pairs` (a, b: sets) whose similarity is 0.8 or more; only texts of sets in pairs move."""
    spark = texts.sparkSession
    heap_returned(spark)  # what the joins that found the pairs have left
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = stored(needed.join(sets.select("node", "k1", "k2"), "node"), "keys")
    held = spark.sparkContext.broadcast(_marks(keys, cells))
    found = _marked(texts, held, cells, "k1").join(keys, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])
    found = stored(found, "texts")
    both = pairs.join(found.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(found.withColumnsRenamed({"node": "b", "text": "tb"}), "b")

    names, kind = pairs.columns, pairs.schema

    def check(batches):
        for batch in blocks(batches, "ta"):
            keep, last, of_last = [], None, None
            for one, other in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if last != other or of_last is None:
                    last, of_last = other, shingle_set(other)
                s = shingle_set(one)
                common = len(np.intersect1d(s, of_last, assume_unique=True))
                keep.append((OVER + UNDER) * common >= OVER * (len(s) + len(of_last)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)
        released()

    near = stored(both.select(*names, "ta", "tb").mapInArrow(check, kind), "near")
    for done in (keys, found):
        dropped(spark, done)
    return near


def _distance(a: str, b: str, width: int) -> Column:
    differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << width) - 1))))
    return F.aggregate(differing, F.lit(0), lambda total, d: total + d)


def _sized(n: str, m: str) -> Column:
    """Whether sizes allow the similarity."""
    return UNDER * F.least(n, m) >= OVER * F.greatest(n, m)


def _allowed(n: str, m: str, odd: str, other: str) -> Column:
    """Whether sizes and parity bits allow the similarity: bits that differ are at most the shingles that one set alone holds."""
    bits = F.lit(0)
    for k in range(LONGS):
        bits = bits + F.bit_count(F.col(odd)[k].bitwiseXOR(F.col(other)[k]))
    return _sized(n, m) & ((OVER + UNDER) * bits <= (UNDER - OVER) * (F.col(n) + F.col(m)))


def _head(width: int, at: int) -> Column:
    """The values of the segments from `at` on, as many as a long holds."""
    mask = F.lit((1 << width) - 1)
    bits = F.col("code")[at].bitwiseAND(mask)
    for k in range(1, 64 // width):
        bits = bits.bitwiseOR(F.shiftleft(F.col("code")[at + k].bitwiseAND(mask), k * width))
    return bits


def _met_before(width: int) -> Column:
    """Whether x and y, which meet in segment x.i, have the value of an earlier segment in common that `first` or `second` holds, so
    that they have met there."""
    out, each = F.lit(False), 64 // width
    for k in range(2 * each):
        differing = F.col("x.first").bitwiseXOR(F.col("y.first")) if k < each else F.col("x.second").bitwiseXOR(F.col("y.second"))
        same = F.shiftright(differing, k % each * width).bitwiseAND(F.lit((1 << width) - 1)) == 0
        out = out | ((F.col("x.i") > k) & same)
    return out


def _near(pairs: DataFrame, sets: DataFrame, width: int, segments: int) -> DataFrame:
    """The rows of `pairs` whose sizes, complete distances and parity bits allow the similarity, with the distance `far`."""
    one, two = (sets.select(F.col("node").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("n", "code", "odd"))) for e in "ab")
    both = pairs.join(one, "a").join(two, "b").where(_allowed("n_a", "n_b", "odd_a", "odd_b")).withColumn("far", _distance("code_a", "code_b", width))
    return both.where(F.col("far") <= int(FAR * width * segments)).select(*pairs.columns, "far")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = 1 << 23) -> DataFrame:
    """(id, k1, k2, root) for each row of `docs`: rows of one root are connected by similarities of 0.8 or more."""
    with batches_of(docs.sparkSession, 1000):
        return _groups(docs, id_col, text_col, cells)


def _groups(docs: DataFrame, id_col: str, text_col: str, cells: int) -> DataFrame:
    spark = docs.sparkSession
    width, segments = layout(docs.count())
    rows = stored(sketches(docs, id_col, text_col, width, segments), "sketches")
    single = rows.dropDuplicates(["s1", "s2"]).withColumn("node", F.monotonically_increasing_id())
    sets = stored(single.withColumns({"first": _head(width, 0), "second": _head(width, 64 // width)}), "sets")
    texts = docs.select(*row_key(docs, id_col, text_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    near_first = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= FAR_FIRST

    # the first round: with one set of each bucket, of those that look near the nearest
    value = lambda c: F.col(c).bitwiseAND((1 << width) - 1)
    listed = sets.select("node", "first", "n", F.posexplode("code").alias("i", "c"))
    listed = listed.select("node", "first", "n", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(value("c")).alias("key")).repartition("key")
    order = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    pivots = listed.groupBy("key").agg(F.min_by(F.struct("node", "first", "n"), order).alias("p"), F.count("*").alias("k")).where("k > 1")
    pivots = pivots.select("key", F.col("p.node").alias("b"), F.col("p.first").alias("fb"), F.col("p.n").alias("m"))
    met = listed.join(pivots, "key").where((F.col("node") != F.col("b")) & near_first("first", "fb") & _sized("n", "m")).select(F.col("node").alias("a"), "b").distinct()
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("far", "b"))), 1, NEAREST)  # of one for each segment at most
    best = _near(met, sets, width, segments).groupBy("a").agg(nearest.alias("s")).select("a", F.explode("s").alias("s")).select("a", F.col("s.b").alias("b"))
    star = _verified(stored(best, "pairs"), sets, texts, cells)
    one = stored(components(star), "groups")

    known = sets.join(one, "node", "left").select("node", "n", "first", "second", "code", "odd", F.coalesce("component", "node").alias("root"))
    known = stored(known.withColumn("class", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(UNDER / OVER)).cast("long")), "roots")
    carried = ("node", "root", "first", "second", "n", "odd")
    spots = known.select(*carried, "class", F.posexplode("code").alias("i", "c"))
    spots = spots.withColumn("i", F.col("i").cast("long"))
    key = lambda cls, v: F.shiftleft(cls, 40).bitwiseOR(F.shiftleft(F.col("i"), 32)).bitwiseOR(v)
    flips = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("c", at).bitwiseAND(255).cast("int")) for at in (32, 40)]
    ball = F.array(value("c"), value("c").bitwiseXOR(flips[0]), value("c").bitwiseXOR(flips[1]), value("c").bitwiseXOR(flips[0]).bitwiseXOR(flips[1]))
    # a set asks for sets of its own size class and the next
    asks = spots.select(*carried, "i", F.explode(F.transform(ball, lambda v: key(F.col("class"), v))).alias("key"))
    haves = spots.select(*carried, F.explode(F.array(key(F.col("class"), value("c")), key(F.col("class") - 1, value("c")))).alias("key"))
    # some dozen size classes share the values of a segment: well above what chance brings together
    crowd = max(CROWDED, known.count() >> width)
    asks, haves = apart(asks, haves, spots.select("root", F.explode(F.array(key(F.col("class"), value("c")), key(F.col("class") - 1, value("c")))).alias("key")), crowd)
    # outside crowded keys, which both sides know alike, the parity bits needn't move
    x, y = (rows.withColumn("odd", F.when(F.col("crowded"), F.col("odd"))).alias(name) for rows, name in ((asks, "x"), (haves, "y")))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & F.when(F.col("x.crowded") & F.col("y.crowded"), _allowed("x.n", "y.n", "x.odd", "y.odd")).otherwise(True)
    ends = {"a": F.least("x.node", "y.node"), "b": F.greatest("x.node", "y.node")}
    ends |= {"ra": F.when(F.col("x.node") < F.col("y.node"), F.col("x.root")).otherwise(F.col("y.root")), "rb": F.when(F.col("x.node") < F.col("y.node"), F.col("y.root")).otherwise(F.col("x.root"))}
    far = F.bit_count(F.col("x.first").bitwiseXOR(F.col("y.first"))) + F.bit_count(F.col("x.second").bitwiseXOR(F.col("y.second")))
    meet = meet & near_first("x.first", "y.first") & (far <= FAR_BOTH) & ~_met_before(width) & _sized("x.n", "y.n")
    more = x.join(y, meet).select(*(c.alias(k) for k, c in ends.items())).distinct()
    links = _verified(stored(_near(more, sets, width, segments).drop("far"), "pairs"), sets, texts, cells)
    two = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = known.join(two.withColumnsRenamed({"node": "root", "component": "whole"}), "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    of_sets = stored(sets.select("s1", "s2", "node").join(named, "node").select("s1", "s2", "root"), "named")
    out = stored(rows.select("id", "k1", "k2", "s1", "s2").join(of_sets, ["s1", "s2"]).select("id", "k1", "k2", "root"), "members")
    for done in (rows, sets, star, one, known, links, of_sets):
        dropped(spark, done)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = 1 << 23) -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest id (null last).

    Null, empty and blank texts are copies of each other. Repeated and null ids are allowed: rows are told apart by 128 bits of id and
    text, and of rows that agree in both, near copies by definition, one stays. A text of any length is taken whole, its distinct
    shingles in memory. Texts without a near copy don't move; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = groups(docs, id_col, text_col, cells)
    heap_returned(spark)
    several = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("s"), F.count("*").alias("n")).where("n > 1")
    several = stored(several.select("root", F.col("s.k1").alias("c1"), F.col("s.k2").alias("c2")), "several")
    touched = found.join(several, "root").select("k1")
    held = spark.sparkContext.broadcast(_marks(touched, cells))
    one, two = fresh(docs, "k1", "k2")
    k1, k2 = row_key(docs, id_col, text_col)
    keyed = docs.withColumns({one: k1, two: k2})
    inside = _marked(keyed, held, cells, one)
    # in a marked cell: leaders of groups, and rows that only share a cell with some group
    members = found.join(several, "root")
    gone = members.where("k1 <> c1 or k2 <> c2").select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct()
    stay = inside.join(gone, [one, two], "left_anti").dropDuplicates([one, two])
    return _marked(keyed, held, cells, one, False).unionByName(stay).select(*docs.columns)

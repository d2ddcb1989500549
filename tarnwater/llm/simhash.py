"""SimHash fingerprints of word shingles, and near-duplicate groups by multi-index hashing.

Fingerprints are computed where the text is read. From then on only distinct fingerprints move. The 64 bits are cut into
segments; two fingerprints at most `distance` bits apart agree in some segment up to a small radius, so each fingerprint looks up
the whole Hamming ball of that radius around each of its segments in a table of segment values, and complete distances are
verified inside the join: only true links leave it. The number of segments follows from the number of fingerprints (fewer and
longer ones as that grows, so that chance matches stay rare); whichever is chosen, the links found are the same.

Large groups of near copies would still be linked pair by pair. So a first, linear round links each fingerprint only with the
smallest one that shares a segment with it, if near enough; the full search then returns links between different groups of that
round only. Links left out join fingerprints which are connected already.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, stored
from .components import components

SEED = 42
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: str, size: int = 4, block: int = 1 << 20) -> Iterator[list[int]]:
    """XXH64 of each shingle of `size` words (A-Z lower-cased, joined by a space), or of all words if they are fewer, block by block."""
    data, digest, at, rest, any_yet = text.encode().lower(), xxhash.xxh64_intdigest, 0, [], False
    while at < len(data):
        end = len(data) if at + block >= len(data) else (m.start() if (m := _SPACE.search(data, at + block)) else len(data))
        words = rest + data[at:end].split()
        at = end
        if len(words) < size:
            rest = words
            continue
        joined = b" ".join(words)
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        yield [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]
        rest, any_yet = words[len(words) - size + 1 :], True
    if rest and not any_yet:
        yield [digest(b" ".join(rest), SEED)]


def fold(blocks_of_hashes: Iterable[list[int]]) -> int:
    """Each bit that over half the hashes have; 0 without hashes. As a signed 64-bit integer."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks_of_hashes:
        n += len(hashes)
        for k in range(0, len(hashes), 1 << 16):
            part = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp long) for each row. Null, empty and blank texts have fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in blocks(batches, "text"):
            found = [fold(shingle_hashes(t or "", size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def plan(n: int, distance: int, weight: float = 0.05) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment: the least work for n fingerprints, a chance match weighing `weight` lookups.

    With m segments and distance = a * m + b, one of the first b + 1 segments agrees within a bits or one of the others
    within a - 1; segments whose radius would be -1 aren't needed.
    """

    def layout(m: int) -> list[tuple[int, int, int]]:
        a, b = divmod(distance, m)
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        offsets = [0, *accumulate(widths)]
        return [(offsets[i], widths[i], a if i <= b else a - 1) for i in range(m) if i <= b or a > 0]

    ball = lambda w, r: sum(math.comb(w, k) for k in range(r + 1))
    work = lambda s: sum(n * ball(w, r) + weight * n * n * ball(w, r) / 2.0**w for _, w, r in s)
    return min((layout(m) for m in range(2, distance + 2)), key=work) if distance else [(0, 64, 0)]


def _keys(fps: DataFrame, segments: list[tuple[int, int, int]], balls: bool) -> DataFrame:
    """fps with a row for each segment (and each value of its ball): `key` tells segment and value."""
    entries = []
    for k, (offset, width, radius) in enumerate(segments):
        masks = [sum(1 << i for i in c) for r in range((radius if balls else 0) + 1) for c in combinations(range(width), r)]
        entries += [(k, offset, width, m) for m in masks]
    listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(o).alias("o"), F.lit((1 << w) - 1 if w < 64 else -1).cast("long").alias("w"), F.lit(m).cast("long").alias("m")) for k, o, w, m in entries))
    out = fps.withColumn("s", F.explode(listed))
    value = F.expr("((shiftrightunsigned(fp, s.o) & s.w) ^ s.m)")
    return out.select("*", F.xxhash64("s.k", value).alias("key") if any(w > 40 for _, w, _ in segments) else (F.col("s.k").cast("long") * F.lit(1 << 40) + value).alias("key")).drop("s")


def apart(asks: DataFrame, haves: DataFrame, listed: DataFrame, many: int = 256, small: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """asks and haves with columns for a join on (key, part), in which a key's largest root doesn't meet itself; `crowded` marks such keys.

    `listed` tells how many rows of which root a key has. In keys of `many` rows and more, rows of the largest root that are had stand in
    part 1 and all others in part 0; rows of the largest root ask part 0, others both. Every pair of different roots still meets,
    once, and a group of N rows that shares a key with k others costs N * k tests rather than N * N.
    """
    sizes = listed.groupBy("key", "root").agg(F.count("*").alias("n"))
    full = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where(F.col("n") >= many)
    full = stored(full.select("key", "top"), "full")
    n = full.count()
    if not n:
        return tuple(rows.withColumns({"part": F.lit(0), "crowded": F.lit(False)}) for rows in (asks, haves))
    held = F.broadcast(full) if n <= small else full  # two longs a row
    major = F.col("root") == F.col("top")
    asks = asks.join(held, "key", "left").withColumn("part", F.explode(F.when(F.col("top").isNull() | major, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    haves = haves.join(held, "key", "left").withColumn("part", F.coalesce(major.cast("int"), F.lit(0)))
    return tuple(rows.withColumn("crowded", F.col("top").isNotNull()).drop("top") for rows in (asks, haves))


def link(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(node, component) for each of the distinct fingerprints (fp long) that has a link; component is its group's least one."""
    spark = fps.sparkSession
    segments = plan(max(fps.count(), 1), distance)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    listed = _keys(fps, segments, False)
    pivots = listed.groupBy("key").agg(F.min("fp").alias("pivot"))
    star = listed.join(pivots, (listed["key"] == pivots["key"]) & (listed["fp"] != pivots["pivot"]) & near("fp", "pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    first = stored(components(star), "groups")
    known = stored(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("component", "fp").alias("root")), "roots")
    asks, haves = apart(_keys(known, segments, True), _keys(known, segments, False), _keys(known, segments, False))
    asks, haves = asks.select("key", "part", F.col("fp").alias("a"), F.col("root").alias("ra")), haves.select("key", "part", F.col("fp").alias("b"), F.col("root").alias("rb"))
    meet = (asks["key"] == haves["key"]) & (asks["part"] == haves["part"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near("a", "b")
    more = asks.join(haves, meet).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    second = components(more.distinct())
    out = known.join(second, known["root"] == second["node"], "left").select(F.col("fp").alias("node"), F.coalesce("component", "root").alias("component"))
    out = stored(out, "groups")
    for done in (first, known):
        dropped(spark, done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(id, fingerprint hex string, component_id) for each row of `docs`.

    Fingerprints at most `distance` bits apart are linked; component_id is the smallest id that links reach, the row's own
    included. Null, empty and blank texts share fingerprint 0 and are linked like any other. A null id stays null and takes
    its group's smallest id, if there is one. A bit that half the hashes have is 0. Repeated rows give repeated rows, an empty table
    none. A long text is hashed block by block. Other columns are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, size), "fps")
    single = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "single")
    groups = single.join(link(single.select("fp"), distance), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Mix sources to target weights: exact word quotas by source, dealt to output shards by a splitting tree.

Each source's documents are put in a seeded order, their words numbered through, and the numbers cut into blocks. A full pass
takes all blocks of a source, a partial one the first so many of a seeded permutation of them, the last of these in part, so that
the words taken equal the target to within one. The number of blocks that each shard gets of each source is drawn by
multivariate hypergeometric splits down a binary tree of shards: quotas are exact at each node, and shards look like random
samples of the whole. A shard holds a range of each source's permuted blocks, so shards never share a block, and `order`
shuffles it locally.

Scale: texts are read once for their word counts, which is all that mix() moves; mixed_documents() moves each text to its spans and then
to its shard, sorted by the order that shuffles it; a shard may lie in several tasks. Word offsets come from a two-level prefix sum (within hash buckets, then
over bucket totals), so a source that holds most rows is spread over many tasks. The driver sees one row per source: sources
are the entries of a mix, named and weighed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

#: Blocks that one splitting tree deals at most.
MOST = 500_000_000
#: Copies of a row that are mixed as one.
COPIES = 1000
SPANS = "array<struct<pass: int, shard: int, order: bigint, from: bigint, to: bigint>>"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: `share` of all words by weight, none above `most` times its size, the excess reshared by weight."""
    left, active, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while active:
        total = sum(weights[i] for i in sorted(active))
        if total <= 0 or left <= 0:
            break
        over = [i for i in sorted(active) if left * weights[i] / total >= most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            active.remove(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int, most: int = MOST) -> np.ndarray:
    """(source, shard) -> blocks; rows add up to the quotas, columns are as even as whole blocks allow.

    The generator draws from populations below a thousand million. A larger one is cut into strata of `most` blocks at most,
    with the sources in proportion, which are dealt one after the other.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def deal(counts: np.ndarray, first: int, n: int, stratum: int) -> None:
        if n == 1:
            out[:, first] += counts
            return
        half, total = n // 2, int(counts.sum())
        draws = np.random.default_rng([seed, first, n, stratum])
        part = draws.multivariate_hypergeometric(counts, total * half // n, method="marginals") if total else counts
        deal(part, first, half, stratum)
        deal(counts - part, first + half, n - half, stratum)

    strata = max(1, -(-sum(quotas) // max(1, most - len(quotas))))
    for k in range(strata if quotas else 0):
        deal(np.array([q * (k + 1) // strata - q * k // strata for q in quotas], np.int64), 0, shards, k)
    return out


def permuted(values: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A bijection of 0..n-1 for each key: a four-round Feistel network on the next even power of two, walked until it falls inside."""
    x, n = values.astype(np.uint64), n.astype(np.uint64)
    half = ((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1)) + np.uint64(0)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right, m, k = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], keys[todo].astype(np.uint64)
        for turn in range(4):
            f = (right + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (k * np.uint64(0xC2B2AE3D27D4EB4F))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        x[todo] = (left << half[todo]) | right
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mixed(key: np.ndarray) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(30))).astype(np.int64)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 64, block_words: int = 4096,
    seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 4_000,
) -> DataFrame:
    """(id, size, source_size, target, taken, spans) for each row of `docs`.

    size: words of the text (null: 0). Sources in code-point order, null last, have `weights` in turn. taken: words that the mix
    takes of the row, at most `most` times its size if most is whole. spans: what it takes, as word ranges [from, to) of the row with
    pass, shard and order in the shard. Rerunning gives the same. Rows that repeat an id are rows of their own; a null id is
    ordered first; rows that agree in id, source and size stand in any order, which their results don't show. Sources without words
    have target 0. A text of any length is a count of words here. An empty table gives no rows. Only id, source and text are read.
    """
    rows = docs.select(docs[id_col].alias("id"), source_key(docs[source_col]).alias("key"), word_count(docs[text_col]).alias("size"))
    return _spans(rows, weights, share, most, shards, block_words, seed, bucket_rows).withColumnRenamed("id", id_col)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _spans(rows: DataFrame, weights, share, most, shards, block, seed, bucket_rows) -> DataFrame:
    """(id, size, source_size, target, taken, spans) for rows of (id of any type, key of the source, size)."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    rows = stored(rows, "sizes")
    listed = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    listed.sort(key=lambda r: (r["key"] == "-", r["key"]))
    sizes = [int(r["size"]) for r in listed]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    facts, instances = {}, []
    for i, (r, size, t) in enumerate(zip(listed, sizes, goal)):
        want = min(round(t), int(most * size))
        full, rest = divmod(want, size) if size else (0, 0)
        whole, odd = size // block, int(size % block > 0)
        n, part = divmod(rest, block)
        facts[r["key"]] = (i, size, t, full, whole, whole + odd, n, part)
        instances.append(full * (whole + odd) + n + (part > 0))
    upto = np.cumsum(split_quotas(instances, shards, seed), axis=1)
    beyond = int(upto.max(initial=0)) + 1
    # one ascending list of all sources' shard ends, so that a lookup is one search
    held = spark.sparkContext.broadcast((facts, (upto + beyond * np.arange(len(upto))[:, None]).ravel()))

    buckets = max(1, -(-sum(r["n"] for r in listed) // bucket_rows))
    placed = rows.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.lit(buckets)).cast("int"))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    upto_bucket = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    before = sums.select("key", "bucket", (F.sum("words").over(upto_bucket) - F.col("words")).alias("base"))
    upto_row = W.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    inside = F.sum("size").over(upto_row) - F.col("size")
    offsets = placed.withColumn("inside", inside).join(before, ["key", "bucket"]).select("id", "key", "size", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches):
        facts, ends_of_shards = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            start, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
            fact = [facts[k] for k in batch.column("key").to_pylist()]
            src, total, full, whole, every, n, part = (np.array([f[k] for f in fact], np.int64) for k in (0, 1, 3, 4, 5, 6, 7))
            first, last = start // block, np.where(size > 0, (start + size - 1) // block, start // block - 1)
            each = last - first + 1
            row = np.repeat(np.arange(len(size)), each)
            b = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            got = []
            for p in range(int(full.max(initial=0)) + 1):
                pick = full[row] >= p
                r, blk = row[pick], b[pick]
                at, inner = whole[r].copy(), blk < whole[r]
                at[inner] = permuted(blk[inner], whole[r][inner], src[r][inner] * 8 + p + seed)
                most_words = np.where((full[r] > p) | (at < n[r]), block, np.where(at == n[r], part[r], 0))
                lo, hi = np.maximum(start[r], blk * block), np.minimum(start[r] + size[r], blk * block + most_words)
                ok = hi > lo
                r, lo, hi, inst = r[ok], lo[ok], hi[ok], p * every[r[ok]] + at[ok]
                shard = np.searchsorted(ends_of_shards, inst + beyond * src[r], side="right") - shards * src[r]
                got.append((r, np.full(len(r), p), shard, _mixed((src[r] << 40) + inst + seed), lo - start[r], hi - start[r]))
            r, p, shard, order, lo, hi = (np.concatenate(x) for x in zip(*got))
            rank = np.lexsort((lo, p, r))
            r, p, shard, order, lo, hi = (x[rank] for x in (r, p, shard, order, lo, hi))
            ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(size)))]).astype(np.int32)
            columns = [pa.array(p.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(order), pa.array(lo), pa.array(hi)]
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["pass", "shard", "order", "from", "to"]))
            taken = np.bincount(r, weights=hi - lo, minlength=len(size)).astype(np.int64)
            goal = pa.array([f[2] for f in fact], pa.float64())
            found = [batch.column("id"), batch.column("size"), pa.array(total), goal, pa.array(taken), spans]
            yield pa.RecordBatch.from_arrays(found, ["id", "size", "source_size", "target", "taken", "spans"])

    return offsets.mapInArrow(run, f"id {kind}, size long, source_size long, target double, taken long, spans {SPANS}")


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 64, block_words: int = 4096,
    seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 4_000,
) -> DataFrame:
    """The mix as documents, in the order of the shards and shuffled inside each: the columns of `docs`, then the shard's number.

    A row of the result is what one block takes of one document in one pass. A document taken whole keeps its text; of one taken in
    part, the words of a run stand joined by single spaces. Other columns are as they were, but for n_chars, which follows the
    text. Ids may be null or repeated: rows are told apart by 128 bits of id, text and source, and rows that agree in these are copies,
    each of which is mixed as often as it is there, with the other columns of one of them. Columns of any name are allowed; the
    last one is `shard`, with underscores in front where `docs` has that already. Null and blank texts have no words and give no rows.
    """
    one, two, part, lo, hi, size, copy, shard, order = fresh(docs, "k1", "k2", "part", "lo", "hi", "size", "copy", "shard", "order")
    held = [docs[c] for c in (id_col, text_col, source_col)]
    keys = (F.xxhash64(*held).alias(one), F.xxhash64(F.lit(1), *reversed(held)).alias(two))
    # equal rows are mixed as one longer text, up to a bound, so that no task gets them all
    rows = docs.select(*(k.alias(n) for k, n in zip(keys, ("k1", "k2"))), source_key(docs[source_col]).alias("key"), word_count(docs[text_col]).alias("size"))
    counted = rows.where("size > 0").groupBy("k1", "k2", "key", "size").agg(F.count("*").alias("n"))
    dealt = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    whole = F.col("size") * F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("part") * COPIES)
    spans = _spans(dealt.select(F.struct("k1", "k2", "part", "size").alias("id"), "key", whole.alias("size")), weights, share, most, shards, block_words, seed, bucket_rows)
    taken = spans.select(F.col("id.k1").alias(one), F.col("id.k2").alias(two), F.col("id.size").alias(size), F.explode("spans").alias("s"))
    copies = F.sequence(F.floor(F.col("s.from") / F.col(size)), F.floor((F.col("s.to") - 1) / F.col(size)))
    cut = taken.withColumn(copy, F.explode(copies))
    base = F.col(copy) * F.col(size)
    runs = cut.select(one, two, size, F.col("s.shard").alias(shard), F.col("s.order").alias(order), (F.greatest("s.from", base) - base).alias(lo), (F.least("s.to", base + F.col(size)) - base).alias(hi))
    joined = docs.withColumns(dict(zip((one, two), keys))).dropDuplicates([one, two]).join(runs, [one, two])
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), (F.col(lo) + 1).cast("int"), (F.col(hi) - F.col(lo)).cast("int"))
    out = joined.withColumn(text_col, F.when((F.col(lo) == 0) & (F.col(hi) == F.col(size)), F.col(text_col)).otherwise(F.array_join(words, " ")))
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.orderBy(shard, order, one, two, lo).select(*docs.columns, shard)

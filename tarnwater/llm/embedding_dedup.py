"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Equal vectors of a label become one representative with a count, so copies cost nothing further. Each representative is signed in
every table; the bits per table grow with the largest label, the number of tables follows from the bits so that a pair at the
threshold is missed in all tables with probability `miss` at most. Rows of a table's bucket meet in one task, where blocks of
cosines are computed in double precision. Buckets over `chunk` rows are cut into chunks and all pairs of chunks are dealt out,
so no task holds more than two chunks and no pair is skipped. A pair that shares several buckets counts in its first table only.
What leaves a bucket is a row per vector with links: its number of links and the least vector it is connected with there. Pairs
are never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for labels of up to n vectors."""
    bits = min(30, max(6, round(math.log2(max(n, 1) / 24)) if n > 24 else 6))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def _links(ids, counts, vectors, signs, table, side, threshold):
    """Links inside one chunk or between two: (id, links, least id it is connected with)."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    if side.any() and not side.all():
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        i, j = np.nonzero((vectors[a] @ vectors[b].T) / np.outer(norms[a], norms[b]) >= threshold)
        i, j = a[i], b[j]
    else:
        i, j = np.nonzero(np.triu((vectors @ vectors.T) / np.outer(norms, norms) >= threshold, 1))
    if not len(i):
        return None
    fresh = ~(signs[i, :table] == signs[j, :table]).any(axis=1)
    links = np.bincount(i[fresh], counts[j[fresh]], len(ids)) + np.bincount(j[fresh], counts[i[fresh]], len(ids))
    label, was = ids.copy(), None
    while was is None or (label != was).any():
        was = label.copy()
        np.minimum.at(label, i, was[j])
        np.minimum.at(label, j, label[i])
    some = np.unique(np.concatenate([i, j]))
    return ids[some], links[some].astype(np.int64), label[some]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6, chunk: int = 1024, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`.

    Rows are compared when their labels are equal and not null. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. n_links counts the other rows within the threshold, copies
    included; component_id is the smallest id that links reach, the row's own included; kept tells whether that is its own.
    Rows that repeat an id are rows of their own; a null id takes its group's smallest id, if there is one. An empty table gives
    no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    exact = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64
    good = F.expr("label is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    single = stored(rows.where("good").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = single.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most, threshold, miss)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                lists = part.column("v").to_pylist()
                sizes = np.array([len(x) for x in lists])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    data = np.array([lists[i] for i in at], np.float64)
                    sent = pa.array([d.tobytes() for d in data.astype(exact)], pa.binary())
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                    data /= np.abs(data).max(axis=1, keepdims=True)
                    up = (data @ planes[dim] > 0).reshape(len(at), tables, bits)
                    signs = (up @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(at)), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(signs.tolist(), pa.list_(pa.int32())), sent], ["node", "signs", "buckets", "data"])

    signed = stored(single.select("node", "v").mapInArrow(sign, "node long, signs binary, buckets array<int>, data binary").join(single.select("node", "label", "n"), "node"), "signed")
    placed = signed.select("node", "n", "signs", "data", "label", F.posexplode("buckets").alias("t", "bucket"))
    key = [F.col("label").cast("string").alias("label"), "t", "bucket", F.length("data").alias("size")]
    large = placed.select(*key).groupBy("label", "t", "bucket", "size").count().where(F.col("count") > chunk)
    large = large.select("label", "t", "bucket", "size", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = placed.select("node", "n", "signs", "data", *key).join(large, ["label", "t", "bucket", "size"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.withColumn("side", F.col("own") > F.col("other")).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    group = ["label", "t", "bucket", "size", "low", "high"]
    dealt = dealt.select(F.xxhash64(*group).alias("g"), *group, "side", "node", "n", "signs", "data")
    dealt = dealt.repartition("g").sortWithinPartitions("g", *group, "node")

    def compare(batches):
        kept: list = []

        def close(part):
            t = pa.Table.from_batches(part)
            if t.num_rows < 2:
                return None
            node, n, side = (t.column(c).to_numpy() for c in ("node", "n", "side"))
            data = np.frombuffer(b"".join(t.column("data").to_pylist()), exact).astype(np.float64).reshape(len(node), -1)
            data /= np.abs(data).max(axis=1, keepdims=True)  # lest products overflow or vanish
            signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), np.int32).reshape(len(node), -1)
            found = _links(node, n, data, signs, t.column("t")[0].as_py(), side.astype(bool), threshold)
            return found and pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "least"])

        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c) for c in group]
            codes = np.stack([c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in names])
            cuts = [0, *(np.flatnonzero((np.diff(codes, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                here = tuple(c[a].as_py() for c in names)
                if here != now and kept:
                    if (out := close(kept)) is not None:
                        yield out
                    kept = []
                now = here
                kept.append(batch.slice(a, b - a))
        if kept and (out := close(kept)) is not None:
            yield out

    found = stored(dealt.mapInArrow(compare, "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = single.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(least, "root").join(links, "node", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("good").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Pieces that the training-data operators share: table access, storage of intermediates, Arrow blocks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, stored  # noqa: F401

#: Words everywhere in this subpackage: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for own columns beside those of `docs`, whatever these are called."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 8 << 20) -> Iterator[None]:
    """While this lasts, texts go to Python in batches of so many rows and bytes (or one row): for operators that hold tables beside them."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {name: spark.conf.get(name, None) for name in bounds}
    for name, most in bounds.items():
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, old in was.items():
            spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


#: What this Python worker keeps from task to task and can build again.
MEMOS: list[dict] = []


def forgotten() -> None:
    """Drop what earlier operators left in this worker: for operators that need the room themselves."""
    for memo in MEMOS:
        memo.clear()
    released()


def released() -> None:
    """Give freed memory back to the system: workers live on after a task, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def heap_returned(spark: SparkSession) -> None:
    """Let executors collect their garbage and give free heap back: it stays with a JVM otherwise, beside all that Python needs later.

    A short task for each core, which as a rule reaches each executor. No more than memory depends on it, so none reached is no error.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def blocks(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about `budget` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = np.cumsum(size) // budget
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def read_local(path: str) -> str:
    """A tokenizer file as text; the path is the caller's parameter and the driver reads it once."""
    with open(os.path.expanduser(path), encoding="utf-8") as f:
        return f.read()


def kept(docs: DataFrame, decide, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, for which decide() says so: it takes a list of texts and returns a list of booleans. No shuffle."""

    def run(batches):
        for batch in blocks(batches, text_col):
            yield batch.filter(pa.array(decide(batch.column(text_col).to_pylist()), pa.bool_()))
        released()

    return docs.mapInArrow(run, docs.schema)

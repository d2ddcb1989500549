"""A corpus from documents to token streams: language, quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next one, with the columns of documents; the last returns
digests. run() writes each stage's rows as Parquet into the shared folder and reads them again.

Executors live through all stages. So each stage first lets them give back the heap that the one before needed, and where a stage's own
code starts the work, texts go to Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwater.llm import bpe_codec, language_id, mixing, near_copies, quality
from tarnwater.llm.common import batches_of, heap_returned, stored, table
from tarnwater.llm.queries import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without a letter, or far from all languages for their length, go."""
    heap_returned(spark)
    with batches_of(spark, 1000):
        return language_id.accept(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score below 0.3 go."""
    heap_returned(spark)
    with batches_of(spark, 1000):
        return quality.accept(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 with fingerprints for a Jaccard similarity of 0.8 of five-word shingles: of each group the smallest id stays."""
    heap_returned(spark)
    return near_copies.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: a row for each run of words that a block of the mix takes of a document, dealt to shards and shuffled inside them."""
    heap_returned(spark)
    return mixing.mixed_documents(docs).select(*docs.columns)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token count and digests of ids and decoded text of each row, written here so that the batches are small."""
    heap_returned(spark)
    with batches_of(spark, 1000):
        return stored(bpe_codec.round_trip(docs, vocabulary_path()), "digests")


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_duplicates", distinct_texts),
    ("mixing", mixed_sources),
    ("bpe", token_digests),
]
#: The stages' methods have no SQL form; tests/llm/test_pipeline.py holds the rows of each, and of run(), against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

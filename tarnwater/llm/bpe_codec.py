"""Encode whole texts with a byte-level BPE vocabulary and decode the ids again; the machines are in bpe.py."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import blocks, released


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row. A null text gives no ids. Ids of one text stand in one row, as their readers need them."""
    held, kind = bpe.shared(docs.sparkSession, tokenizer), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np

        vocabulary, encoder = bpe.ready(*held.value)
        for batch in blocks(batches, "text"):
            packed = [b"".join(encoder.encode(vocabulary, t or "")) for t in batch.column("text").to_pylist()]
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), ids)], ["id", "ids"])
        released()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; broken byte sequences become replacement characters. Null ids give null."""
    held, kind = bpe.shared(encoded.sparkSession, tokenizer), encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np

        vocabulary, _ = bpe.ready(*held.value)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                texts.append(None if ids.as_py() is None else bpe.Decoder(vocabulary).feed(np.array(ids.as_py(), "<u4").tobytes(), True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode its ids, and keep digests of both streams.

    Ids pass block by block from the encoder to the decoder and the digests, so that no text's ids are ever held whole.
    A null text counts as empty; a null id stays null; repeated rows give repeated rows.
    """
    held, kind = bpe.shared(docs.sparkSession, tokenizer), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary, encoder = bpe.ready(*held.value)
        for batch in blocks(batches, "text"):
            counts, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                machine, n, of_ids, of_text = bpe.Decoder(vocabulary), 0, hashlib.sha256(), hashlib.sha256()
                for packed in encoder.encode(vocabulary, text or ""):
                    n += len(packed) // 4
                    of_ids.update(packed)
                    of_text.update(machine.feed(packed).encode())
                of_text.update(machine.feed(b"", True).encode())
                counts.append(n)
                ids.append(of_ids.hexdigest())
                texts.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

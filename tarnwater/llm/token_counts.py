"""Token counts of whole texts without token ids.

Texts are cut into pre-tokens. In each block of texts, the distinct pre-tokens are found by dictionary encoding, each is counted
once by the tokenizer (a bounded memo spans blocks and tasks), the counts are joined to the pre-token frequencies through
the dictionary's indices, and summed by document. Everything happens where the text is read: there is no shuffle, whatever the
input's size, and memory holds one block of about 4 MB of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from .common import blocks

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"
_COUNTERS: dict[int, tuple] = {}


def _counter(source: str, differ: dict[str, str]):
    key = hash((source, *sorted(differ.items())))
    if key not in _COUNTERS:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(source)
        model.no_truncation()
        model.no_padding()
        _COUNTERS[key] = bpe.Vocabulary(source, differ), model, {}
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, memo: int = 400_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of `docs`; other columns are not read.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows give repeated rows. Texts of any
    length are counted whole. `tokenizer` is the path of a byte-level BPE JSON file; no begin, end or padding tokens are added, and
    special strings inside a text count as the one token the library makes of them. `memo` bounds the remembered pre-tokens.
    """
    held = bpe.shared(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary, model, known = _counter(*held.value)
        for batch in blocks(batches, "text"):
            texts = batch.column("text")
            flat, ends, extra = [], [], []
            for text in texts.to_pylist():
                more = 0
                for part, special in vocabulary.segments(text or ""):
                    if special is not None:
                        more += 1
                        continue
                    for found in vocabulary.pieces(part):
                        flat += found
                ends.append(len(flat))
                extra.append(more)
            pieces = pa.array(flat, pa.string()).dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            if len(known) > memo:
                known.clear()
            fresh = [p for p in distinct if p not in known]
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                known.update(zip(part, map(len, model.encode_batch_fast(part, add_special_tokens=False))))
            per = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
            upto = np.concatenate([[0], np.cumsum(per[pieces.indices.to_numpy(zero_copy_only=False)] if flat else per)])
            tokens = np.diff(upto[[0, *ends]]) + np.array(extra, np.int64)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)

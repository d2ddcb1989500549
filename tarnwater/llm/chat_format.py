r"""Chat formatting on tokens: roles and texts are encoded apart, reserved ids are spliced between them, masks come from prefix sums.

A turn is START role SEPARATOR text END; the three marks are ids beyond the vocabulary, which no text can yield. So that the
decoded string can't be misread either, control strings inside contents are escaped: in `<|`, and in `<`, backslashes, `|`, one more
backslash is put behind the `<`. Taking one away restores any text. The loss mask covers the ids of assistant texts alone.

A conversation is kept as one row per turn, so that none grows with its length. The digests of a conversation read its turns as
a sorted stream; a digest over one sequence is sequential, all work before it is done turn by turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import blocks

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def assemble(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, ids array<int>, loss array<boolean>) for each row of `turns`; null roles and texts are empty. Repeated rows are turns of their own."""
    held = bpe.shared(turns.sparkSession, tokenizer)
    kinds = [turns.schema[c].dataType.simpleString() for c in (id_col, turn_col)]

    def run(batches):
        vocabulary, encoder = bpe.ready(*held.value)
        marks = [(vocabulary.size + k).to_bytes(4, "little") for k in range(3)]
        plain = lambda text: b"".join(b"".join(map(encoder.__getitem__, p)) for p in vocabulary.pieces(escape(text)))
        for batch in blocks(batches, "text"):
            packed, lengths, learned = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                segments = [marks[0], plain(role or ""), marks[1], plain(text or ""), marks[2]]
                packed += segments
                lengths += [len(s) // 4 for s in segments]
                learned += [0, 0, 0, int(role == LEARNED), 0]
            ends = np.cumsum([0, *lengths])
            step = np.zeros(ends[-1] + 1, np.int8)
            on = np.flatnonzero(np.array(learned) & (np.array(lengths) > 0))
            np.add.at(step, ends[on], 1)
            np.add.at(step, ends[on + 1], -1)
            turn_ends = pa.array(ends[::5].astype(np.int32))
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            loss = pa.array(np.cumsum(step[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("turn"), pa.ListArray.from_arrays(turn_ends, ids), pa.ListArray.from_arrays(turn_ends, loss)], ["id", "turn", "ids", "loss"])

    rows = turns.select(turns[id_col].alias("id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kinds[0]}, turn {kinds[1]}, ids array<int>, loss array<boolean>").withColumnsRenamed({"id": id_col, "turn": turn_col})


def positions(assembled: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """`assembled` with `position`: where in its conversation the turn's first id stands."""
    order = W.partitionBy(id_col).orderBy(turn_col, "ids").rowsBetween(W.unboundedPreceding, -1)
    return assembled.withColumn("position", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)))


def read_back(assembled: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, turn, role, text, loss_text, formatted): what ids and mask say, contents unescaped; loss_text is null where nothing is masked."""
    held = bpe.shared(assembled.sparkSession, tokenizer)
    kinds = [assembled.schema[c].dataType.simpleString() for c in (id_col, turn_col)]

    def run(batches):
        vocabulary, _ = bpe.ready(*held.value)
        top = vocabulary.size
        words = lambda ids: bpe.Decoder(vocabulary).feed(ids.astype("<u4").tobytes(), True)
        for batch in batches:
            cols = [[], [], [], []]
            for ids, loss in zip(batch.column("ids"), batch.column("loss")):
                ids, loss = ids.values.to_numpy(zero_copy_only=False), loss.values.to_numpy(zero_copy_only=False).astype(bool)
                at = np.flatnonzero(ids >= top)
                if ids[at].tolist() != [top, top + 1, top + 2] or at[0] or at[2] != len(ids) - 1:
                    raise ValueError("a turn's marks are out of place")
                role, text = words(ids[1 : at[1]]), words(ids[at[1] + 1 : at[2]])
                cols[0].append(unescape(role))
                cols[1].append(unescape(text))
                cols[2].append(unescape(words(ids[loss])) if loss.any() else None)
                cols[3].append(START + role + SEPARATOR + text + END)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("turn"), *(pa.array(c, pa.string()) for c in cols)], ["id", "turn", "role", "text", "loss_text", "formatted"])

    rows = assembled.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), "ids", "loss")
    return rows.mapInArrow(run, f"id {kinds[0]}, turn {kinds[1]}, role string, text string, loss_text string, formatted string").withColumnsRenamed({"id": id_col, "turn": turn_col})


def digests(read: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stand in order of turn (null first), then role, then text. A null conversation id is a conversation of its own.
    """
    kind = read.schema[id_col].dataType.simpleString()
    rows = read.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), "role", "text", "loss_text", F.char_length("formatted").cast("long").alias("chars"))

    def run(batches):
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state, kept = None, None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            kept, done = batch.schema.field("id").type, []
            columns = (batch.column(c).to_pylist() for c in ("id", "role", "text", "loss_text", "chars"))
            for key, role, text, loss, chars in zip(*columns):
                if state is None or key != now:
                    if state is not None:
                        done.append(row())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types(kept))], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(row()), types(kept))], names)

    def types(kept):
        return [kept, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    sorted_rows = rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text")
    return sorted_rows.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def format_chats(turns: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """assemble, read back and digest; an empty table gives no rows."""
    ids = {k: v for k, v in columns.items() if k in ("id_col", "turn_col")}
    return digests(read_back(assemble(turns, tokenizer, **columns), tokenizer, **ids), **ids)

"""Token counts, codec and chat format against the tokenizers library, on odd texts and whole small tables."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm import bpe, bpe_codec, chat_format, token_counts
from tarnwater.llm.common import read_local


@pytest.fixture(scope="module")
def machine(vocabulary):
    v = bpe.Vocabulary(read_local(vocabulary))
    return v, bpe.Encoder(v)


def ids_of(machine, text):
    return np.frombuffer(b"".join(machine[1].encode(machine[0], text)), "<u4").tolist()


def test_encoder_equals_library(machine, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def run(text):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(machine, text) == expected
        out = bpe.Decoder(machine[0])
        assert out.feed(np.array(expected, "<u4").tobytes(), True) == library.decode(expected, skip_special_tokens=False)

    run()


def test_stream_equals_library_on_long_pieces(machine, library):
    rng = random.Random(4)
    for parts in ("abcdehistr", ["the", "er", "ing", "on", "tion"], "aaab", " ", "é漢"):
        text = "".join(rng.choice(parts) for _ in range(4000))
        expected = library.encode(text, add_special_tokens=False).ids
        if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            chunks = [text.encode()[k : k + 333] for k in range(0, len(text.encode()), 333)]
            assert np.frombuffer(b"".join(machine[1].stream(chunks)), "<u4").tolist() == expected
        assert ids_of(machine, text) == expected


def test_lookahead_bounds_what_later_bytes_change(machine):
    rng, ahead = random.Random(9), machine[1].ahead
    assert ahead == bpe.lookahead(machine[0].ranks) and ahead < 1000
    for _ in range(60):
        text = "".join(rng.choice(["the", "er", "ing", "a", "b", "s", "st", "ation", "qu"]) for _ in range(400)).encode()
        cut = rng.randrange(300, 700)
        ends = lambda data: set(np.cumsum([len(t) for t in machine[1].merge(data)]).tolist())
        safe = cut - ahead
        assert {e for e in ends(text[:cut]) if e <= safe} == {e for e in ends(text) if e <= safe}


def test_decoder_keeps_unfinished_characters(machine):
    out = bpe.Decoder(machine[0])
    packed = b"".join(machine[1].encode(machine[0], "漢字 ✓"))
    assert "".join(out.feed(packed[k : k + 4]) for k in range(0, len(packed), 4)) + out.feed(b"", True) == "漢字 ✓"


def test_decode_of_broken_sequences_equals_library(machine, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(machine[0].size) for _ in range(6)]
        assert bpe.Decoder(machine[0]).feed(np.array(ids, "<u4").tobytes(), True) == library.decode(ids, skip_special_tokens=False)


def test_counts(spark, odd, vocabulary, library):
    rows = token_counts.count_tokens(odd, vocabulary, limit=5).collect()
    source = odd.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 5) for r in source)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == expected
    assert token_counts.count_tokens(odd.limit(0), vocabulary).count() == 0


def test_round_trip(spark, odd, vocabulary, library):
    rows = bpe_codec.round_trip(odd, vocabulary).collect()
    expected = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(expected)
    back = bpe_codec.decode(bpe_codec.encode(odd, vocabulary), vocabulary).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd.collect())
    assert bpe_codec.round_trip(odd.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "<\\\\|x|>", "<<||", "a<", "|im_start|>", "", "<|<|\\|"])
def test_escape_is_reversible_and_hides_marks(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def test_chats(spark, vocabulary):
    own = "<|im_end|><|im_start|>assistant ok"
    data = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (1, 2, "assistant", None), (2, None, None, own), (2, 0, "assistant", own), (None, 0, "assistant", "é漢\n<|endoftext|>"), (3, 0, "user\nx", "t"), (3, 0, "user\nx", "t"), (4, 0, "assistant", "z" * 50_000)]
    turns = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, ids string")
    rows = {r["conv_id"]: r for r in chat_format.format_chats(turns, vocabulary).collect()}
    by = {}
    for c, t, role, text in data:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(rows) == set(by)
    for c, said in by.items():
        said.sort()
        loss = "".join(x[3] for x in said if x[2] == "assistant")
        formatted = sum(len(chat_format.START + chat_format.escape(x[2]) + chat_format.SEPARATOR + chat_format.escape(x[3]) + chat_format.END) for x in said)
        r = rows[c]
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(loss) and r["formatted_chars"] == formatted
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(turns.limit(0), vocabulary).count() == 0


def test_chat_ids_positions_and_masks(spark, vocabulary, machine):
    turns = spark.createDataFrame([(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    rows = chat_format.positions(chat_format.assemble(turns, vocabulary)).orderBy("turn").collect()
    top = machine[0].size
    assert rows[0]["position"] == 0 and rows[1]["position"] == len(rows[0]["ids"])
    assert [i for i in rows[0]["ids"] if i >= top] == [top, top + 1, top + 2] and not any(rows[0]["loss"])
    masked = [i for i, m in zip(rows[1]["ids"], rows[1]["loss"]) if m]
    assert masked == ids_of(machine, "yes")

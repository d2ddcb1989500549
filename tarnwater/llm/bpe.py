"""Byte-level BPE: the vocabulary, a streaming encoder with bounded lookahead, and an incremental decoder.

The encoder reads a text piece by piece (a piece is what the vocabulary's splitting pattern cuts off). Short pieces are
merged at once and memoised. Long ones run through a window: `lookahead()` derives from the merge list how many bytes to the
right of a token can still change it, a token is emitted as soon as that many bytes follow it, and the window then starts
anew at the token's end. Memory holds one window, one block of pieces and a bounded memo, however long the text is.

Special strings that the vocabulary file lists are cut out of texts first, as the library does by default.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex

from .common import MEMOS, read_local

#: Fixed value: the published splitting pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file: itself if visible, else the next letter from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file in the `tokenizers` JSON format."""

    def __init__(self, source: str, differ: dict[str, str] | None = None):
        spec = json.loads(source)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        extra = spec.get("added_tokens") or []
        if any(t.get(k) for t in extra for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that strip or normalise their surroundings are not supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in extra}
        self.ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.special}
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = Splitter(letter_classes() if differ is None else differ)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text without special strings, and between them their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            yield text, None
            return
        for k, part in enumerate(self.cut.split(text)):
            yield (part, None) if k % 2 == 0 else ("", self.special[part])

    def pieces(self, text: str, most: int = 1 << 18) -> Iterator[list[str]]:
        """Lists of pieces, a bounded number at a time."""
        split = self.split(text)
        if len(text) <= most:
            yield split.findall(text)
            return
        found = split.finditer(text)
        while part := [m[0] for m in islice(found, most >> 2)]:
            yield part


_CLASSES: list[dict[str, str]] = []


def letter_classes() -> dict[str, str]:
    """Code points that the installed library takes for letters, digits, spaces or others, but `regex` does not.

    The two may carry different Unicode tables. The library's own splitter sees each code point behind a letter, a digit and a
    sign: where it doesn't break off, it is of that class; where it always does, it is a space. Done once a process.
    """
    if not _CLASSES:
        from tokenizers.pre_tokenizers import ByteLevel

        cut = ByteLevel(add_prefix_space=False, use_regex=True)
        settled = regex.compile(r"[\u4E00-\u9FA5\uAC00-\uD7A3\uE000-\uF8FF]")
        points = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x32400)]) if not settled.match(c)]
        theirs = dict.fromkeys(points, "S")
        for sign, kind in (("a", "L"), ("1", "N"), ("!", "O")):
            for k in range(0, len(points), 20_000):
                some = points[k : k + 20_000]
                starts = {span[0] for _, span in cut.pre_tokenize_str("\n".join(sign + c for c in some))}
                theirs |= {c: kind for i, c in enumerate(some) if 3 * i + 1 not in starts}
        text = "".join(points)
        ours = dict.fromkeys(points, "O") | {c: k for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")) for c in regex.findall(p, text)}
        _CLASSES.append({k: "".join(c for c in points if theirs[c] == k != ours[c]) for k in "LNSO"})
    return _CLASSES[0]


class Splitter:
    """SPLIT with the library's classes. Texts without a code point on which the tables differ take the plain pattern."""

    def __init__(self, differ: dict[str, str]):
        self.plain, self.exact, self.doubt = regex.compile(SPLIT), None, None
        every = "".join(differ.values())
        if every:
            written = lambda text: "".join(f"\\U{ord(c):08X}" for c in text)
            own = {}
            for kind, known in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
                less = f"[{known}--[{written(every)}]]"
                own[kind] = f"[{less}||[{written(differ[kind])}]]" if differ[kind] else less
            rest = f"[^[{own['S']}||{own['L']}||{own['N']}]]"
            self.exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{own['L']}+| ?{own['N']}+| ?{rest}+|{own['S']}+(?![^{own['S']}])|{own['S']}+", regex.V1)
            self.doubt = re.compile("[" + re.escape("".join(c for c in every if c < "\U00010000")) + "]"), re.compile("[\U00010000-\U0010FFFF]")

    def __call__(self, text: str):
        return self.exact if self.exact and not text.isascii() and any(p.search(text) for p in self.doubt) else self.plain


def lookahead(ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Bytes to the right of a token that can still change it: what follows further on never does.

    Compare the merges of a text with those of its prefix. Their pieces agree left of a frontier that starts at the prefix's
    end and moves left only when a merge takes a piece that begins at the frontier as its right half. Merges fire in rank
    order, so one pass over them keeps, for each token, how far left of the end a frontier at its beginning can lie.
    """
    reach: dict[bytes, int] = {}
    for left, right in sorted(ranks, key=ranks.get):
        whole, moved = left + right, reach.get(right, 0) + len(left)
        reach[whole] = max(reach.get(whole, 0), reach.get(left, 0), moved)
        reach[left] = max(reach.get(left, 0), moved)
    return max(reach.values(), default=0)


class Encoder(dict):
    """piece -> its ids as little-endian 32-bit integers. A bounded memo; missing pieces are merged when first asked for."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000, ahead: int | None = None):
        super().__init__()
        self.ranks, self.ids, self.most = vocabulary.ranks, vocabulary.ids, most
        self.packed = {k: v.to_bytes(4, "little") for k, v in self.ids.items()}
        self.ahead = lookahead(self.ranks) if ahead is None else ahead

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > 2 * self.ahead + 256:
            return b"".join(self.stream([data]))
        out = b"".join(map(self.packed.__getitem__, self.merge(data)))
        if len(self) >= self.most:
            self.clear()
        self[piece] = out
        return out

    def merge(self, data: bytes) -> list[bytes]:
        """All merges of a short run of bytes, lowest rank first, leftmost among equals."""
        if data in self.packed:
            whole = [data]
            if len(data) == 1:
                return whole
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        if len(parts) > 64:
            return self._merge_long(parts)
        none = sys.maxsize
        cost = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while cost and (best := min(cost)) < none:
            i = cost.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(cost):
                cost[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != whole or (parts[i], parts[j]) not in ranks:
                continue
            parts[i], parts[j], after[i] = whole, b"", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def stream(self, chunks) -> Iterator[bytes]:
        """The transducer: takes one piece in chunks of bytes, emits packed ids once `ahead` bytes follow them."""
        window, room = b"", 2 * self.ahead + 256
        for chunk in chunks:
            for k in range(0, len(chunk), room):
                window += chunk[k : k + room]
                if len(window) <= room:
                    continue
                end, ready = 0, []
                for token in self.merge(window):
                    if end + len(token) > len(window) - self.ahead:
                        break
                    ready.append(self.packed[token])
                    end += len(token)
                window = window[end:]
                yield b"".join(ready)
        yield b"".join(map(self.packed.__getitem__, self.merge(window)))

    def encode(self, vocabulary: Vocabulary, text: str) -> Iterator[bytes]:
        """Packed ids of a text, block by block."""
        for part, special in vocabulary.segments(text):
            if special is not None:
                yield special.to_bytes(4, "little")
            elif part:
                for found in vocabulary.pieces(part):
                    yield b"".join(map(self.__getitem__, found))


class Decoder:
    """Ids to text: looks up bytes and runs them through an incremental UTF-8 machine that keeps unfinished characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.look = vocabulary.bytes.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, packed: bytes, final: bool = False) -> str:
        data = b"".join(map(self.look, np.frombuffer(packed, "<u4").tolist()))
        return self.machine.decode(data, final)


_READY: dict[int, tuple[Vocabulary, Encoder]] = {}
MEMOS.append(_READY)


def ready(source: str, differ: dict[str, str]) -> tuple[Vocabulary, Encoder]:
    """Vocabulary and memo of this Python worker, kept from task to task."""
    key = hash((source, *sorted(differ.items())))
    if key not in _READY:
        vocabulary = Vocabulary(source, differ)
        _READY[key] = vocabulary, Encoder(vocabulary)
    return _READY[key]


def shared(spark, path: str):
    """The vocabulary file and the class differences, read once by the driver and broadcast (a few MB, fixed by the file)."""
    source, differ = read_local(path), letter_classes()
    Vocabulary(source, differ)  # refuse unsupported files here rather than in a task
    return spark.sparkContext.broadcast((source, differ))

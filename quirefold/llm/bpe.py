"""BPE encoding and decoding of whole texts.

A word is a doubly linked list of symbols; the ranks of all mergeable
neighbours wait in a priority queue.  The least rank (leftmost first) is
merged, its new neighbours are queued, and entries whose symbols have changed
meanwhile are stale and skipped.  Decoding concatenates vocabulary strings
(with the separator that the file's missing decoder implies).

Texts are normalised as the file asks (NFC, white space, lower case letter by
letter), split at special tokens, then into words; as no word crosses white
space, each white-space-free chunk is encoded once per worker and kept in a
table of bounded size.

Letters, numbers and normal forms are the library's own.

Null text: no ids and an empty decoded text.  Repeated rows are encoded one by
one, an empty table gives no rows, and ties of rank go to the left.
Everything is map-only: no shuffle, and a lost task costs its own rows.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.packing import byte_letters

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Chunks kept by a worker, and their bytes with ids and decoded forms; the table starts anew beyond either.
KEPT, KEPT_BYTES = 200_000, 64 << 20

_WHITE = r"\t-\r \x85\xa0  -     　"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{_WHITE}]+")


def _class(pattern: str) -> str:
    """The characters that the library's own regular expressions match, as the inside of a character class."""
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(everything)
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run, _ in runs)


class Bpe:
    def __init__(self, path: str):
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) -> rank and new id
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.suffix] for b in range(256)]
        letter, number = _class(r"[\p{L}]+"), _class(r"[\p{N}]+")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_WHITE}{letter}{number}]+")
        #: The library's own, as its Unicode tables are older than Python's.
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def merge(self, s: list[int]) -> list[int]:
        """Symbols after all merges."""
        n = len(s)
        if n == 1:
            return s
        bits = 24 if n < 1 << 24 else 40
        places = (1 << bits) - 1
        get = self.merges.get
        heap = []  # rank and new id, then position
        for i in range(n - 1):
            m = get(s[i] << 20 | s[i + 1])
            if m is not None:
                heap.append(m << bits | i)
        if not heap:
            return s
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            m = heappop(heap)
            i, m = m & places, m >> bits
            j = after[i]
            if j == n or s[i] < 0 or get(s[i] << 20 | s[j]) != m:
                continue  # stale
            s[i] = m = m & 0xFFFFF
            s[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = get(m << 20 | s[k])
                if p is not None:
                    heappush(heap, p << bits | i)
            h = before[i]
            if h >= 0:
                p = get(s[h] << 20 | m)
                if p is not None:
                    heappush(heap, p << bits | h)
        return [x for x in s if x >= 0]

    def word(self, chars: str) -> list[int]:
        raw = chars.encode()
        inner = self.inner
        return self.merge([*(inner[b] for b in raw[:-1]), self.last[raw[-1]]])

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without white space or special tokens."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        return self.words.findall(self.normal.normalize_str(text))

    def decode(self, ids) -> str:
        return " ".join(self.strings[i] for i in ids)


class _Kept(dict):
    """Chunk -> little-endian ids and their decoded form, in two generations of bounded size."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.older, self.bytes = bpe, {}, 0

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        out = self.older.get(chunk)
        if out is None:
            words = self.bpe.split(chunk)
            if words == [chunk]:
                ids = self.bpe.word(chunk)
                out = struct.pack(f"<{len(ids)}I", *ids), self.bpe.decode(ids)
            else:  # its words are chunks of their own
                parts = [self[w] for w in words]
                out = b"".join([a for a, _ in parts]), " ".join([b for _, b in parts])
        self[chunk] = out
        self.bytes += len(chunk) + len(out[0]) + len(out[1])
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        if len(self) > KEPT or self.bytes > KEPT_BYTES:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        if "<|" in text:
            ids, decoded = [], []
            for part in self.bpe.marks.split(text):
                if part in self.bpe.special:
                    ids.append(self.bpe.special[part].to_bytes(4, "little"))
                    decoded.append(part)
                elif part:
                    a, b = self._plain(part)
                    ids.append(a)
                    decoded += [b] if b else []
            return b"".join(ids), " ".join(decoded)
        return self._plain(text)

    def _plain(self, text: str) -> tuple[bytes, str]:
        chunks = [c for c in _SPLIT.split(text) if c] if _CONTROLS.search(text) else text.split()
        done = list(map(self.__getitem__, chunks))
        return b"".join([a for a, _ in done]), " ".join([b for _, b in done])


_kept: dict[str, _Kept] = {}


def kept(path: str | None) -> _Kept:
    import public_tokenizers

    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _kept:
        _kept[path] = _Kept(Bpe(path))
    return _kept[path]


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text (and any named as results), plus ids (little-endian 32-bit, binary), n_tokens and decoded."""
    others = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "decoded", "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(vocabulary)
        for batch in batches:
            done = [table.encode(t or "") for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array([a for a, _ in done], pa.binary()), pa.array([len(a) // 4 for a, _ in done], pa.int64()), pa.array([b for _, b in done], pa.string())],
                names=[*others, "ids", "n_tokens", "decoded"],
            )

    source = docs.select(*others, F.col(text_col).alias("_text"))
    schema = docs.select(*others).schema.add("ids", "binary").add("n_tokens", "long").add("decoded", "string")
    return source.mapInArrow(run, schema)

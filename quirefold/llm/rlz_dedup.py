"""Substring dedup by relative Lempel-Ziv parsing: every run of ``min_words`` words that repeats is cut.

Reference blocks hold the contexts of anchors (see ``blocks``): an anchor that
is picked at two places or more sends each of its contexts, that is the words
from which its windows are made, ``min_words - gram`` before it and
``min_words`` from it on.  A context that a block of documents holds often is
sent once.  All contexts of an anchor meet in one reference block, which is
indexed by sorting its contexts, word by word from a given offset on.

Each context is then factored greedily against the others there: the factor at
an offset is the longest run that another context of the anchor has at the same
offset, that is the longer match with its two neighbours in the sorted order.
Factors of ``min_words`` words or more are duplicate spans and the parse goes
on behind them.  A repeated run that lies across the end of a factor is in no
factor, so the offsets around each factor's end (those whose run of
``min_words`` words crosses it) begin factors of their own.  Together: a run of
``min_words`` words repeats if and only if it lies in a duplicate span.

Words are sorted as hashes; each factor is then confirmed on the words
themselves, and a reference block in which that fails is factored again on its
words.  An anchor with more than ``blocks.HOT`` places is no seed for all its
contexts: its windows become contexts of their own, under their own hash, so
that no task meets an unbounded group.

Results: null text -> no words, text stays null; fewer than ``min_words``
words -> nothing is cut; repeated rows count as documents of their own, so
their windows repeat; extra columns are carried along unchanged (those named
as results are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.llm.arrays import mix, window_names, word_slices, words_hash
from quirefold.llm.blocks import BLOCK, HOT, Seeds, by_key, cover, dealt, gathered, member, normalised, rewritten, shared_anchors, with_spans

GRAM = 8
#: Contexts of a reference block that are factored at a time.
ROWS = 8_000
_EMPTY = {"key": pa.int64(), "sid": pa.int64(), "block": pa.int32(), "lead": pa.int32(), "n": pa.int32(), "words": pa.binary()}


class _Contexts:
    """The contexts of a slice: those of wanted anchors, and windows of wanted names."""

    def __init__(self, s: Seeds, window: int, gram: int):
        self.s, self.window, self.before = s, window, window - gram
        self.text, self.at = normalised(s.words)

    def around(self, anchors: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(word of the anchor, words before it, context)."""
        first = self.s.words.first
        doc = np.searchsorted(first, anchors, side="right") - 1
        a = np.maximum(first[doc], anchors - self.before)
        b = np.minimum(first[doc + 1], anchors + self.window)
        text = self.text
        for p, lead, x, y in zip(anchors.tolist(), (anchors - a).tolist(), self.at[a].tolist(), self.at[b].tolist(), strict=True):
            yield p, lead, text[x:y]

    def windows(self, starts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(first word, 0, window)."""
        text = self.text
        for p, x, y in zip(starts.tolist(), self.at[starts].tolist(), self.at[starts + self.window].tolist(), strict=True):
            yield p, 0, text[x:y]


def _sid(lead: int, words: bytes) -> int:
    """A context's name in its block."""
    return int.from_bytes(blake2b(words, digest_size=8, salt=lead.to_bytes(4, "little")).digest(), "little", signed=True)


def _send(text_col: str, window: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in _EMPTY.items()})
        keys, hot = right["key"].to_numpy().view(np.uint64), right["hot"].to_numpy()
        warm, hot = np.sort(keys[~hot]), np.sort(keys[hot])
        count: dict[tuple[int, int, bytes], int] = defaultdict(int)
        for words in word_slices(left[text_col]):
            s = Seeds(words, window, gram)
            if not len(s.starts):
                continue
            at = s.anchors()
            at = at[member(s.grams[at], warm)]
            c = _Contexts(s, window, gram) if len(at) or len(hot) else None
            for key, (_, lead, x) in zip(s.grams[at].tolist(), c.around(at) if len(at) else (), strict=True):
                count[key, lead, x] += 1
            if len(hot):
                at = s.starts[member(s.grams[s.picked], hot)]
                names = window_names(s.hashes, window)[at].tolist() if len(at) else []
                for key, (_, lead, x) in zip(names, c.windows(at) if len(at) else (), strict=True):
                    count[key, lead, x] += 1
        rows = list(count)
        return pa.table(
            {
                "key": np.array([k for k, _, _ in rows], np.uint64).view(np.int64),
                "sid": pa.array([_sid(lead, x) for _, lead, x in rows], pa.int64()),
                "block": np.full(len(rows), left[BLOCK][0].as_py(), np.int32),
                "lead": pa.array([lead for _, lead, _ in rows], pa.int32()),
                "n": pa.array([min(n, 2) for n in count.values()], pa.int32()),
                "words": pa.array([x for _, _, x in rows], pa.binary()),
            }
        )

    return run


class Reference:
    """Contexts of a reference block as a matrix of words, aligned at their anchors."""

    def __init__(self, table: pa.Table, window: int, gram: int, exact: bool = False):
        words = table["words"].combine_chunks()
        self.raw = words.to_pylist()
        self.key, self.copies = table["key"].to_numpy(), table["n"].to_numpy() > 1
        self.window, m = window, len(self.raw)
        data = np.frombuffer(b"".join(self.raw), np.uint8)
        ends = np.flatnonzero(data == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = np.array([len(x) for x in self.raw])
        base = np.cumsum(size) - size
        first = np.searchsorted(starts, base)
        n = np.diff(np.append(first, len(starts)))
        self.begin = window - gram - table["lead"].to_numpy().astype(np.int64)  # column of a context's first word
        self.end = self.begin + n
        if exact:
            names: dict[bytes, int] = {}
            ids = np.array([names.setdefault(w, len(names)) for x in self.raw for w in x[:-1].split(b" ")], np.int64)
        else:
            letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            _, ids = np.unique(words_hash(letters, data, starts, ends), return_inverse=True)
        row = np.repeat(np.arange(m), n)
        self.columns = 2 * window - gram
        # a missing word equals no other
        self.cells = (ids.max(initial=0) + 1 + np.arange(m * self.columns)).reshape(m, self.columns)
        col = np.arange(len(ids)) - np.repeat(first, n) + np.repeat(self.begin, n)
        self.cells[row, col] = ids
        #: byte at which each word begins in its context, and the context's length
        self.bytes = np.zeros((m, self.columns + 1), np.int64)
        self.bytes[row, col + 1] = ends + 1 - np.repeat(base, n)
        _, self.group = np.unique(self.key, return_inverse=True)

    def longest(self, rows: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the longest run from column q that another row of its group has there, and that row."""
        k = np.concatenate([self.group[rows][:, None], self.cells[rows, q:]], axis=1).astype(">u4")
        order = np.argsort(np.ascontiguousarray(k).view(f"S{4 * k.shape[1]}").ravel(), kind="stable")
        k = k[order]
        same = k[1:] == k[:-1]
        run = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) - 1  # the group's column apart
        run = np.maximum(run, 0)
        up, down = np.concatenate([[0], run]), np.concatenate([run, [0]])
        at = np.arange(len(rows))
        mate = np.where(up >= down, at - 1, np.minimum(at + 1, len(rows) - 1))
        length, other = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        length[order], other[order] = np.maximum(up, down), rows[order[mate]]
        return length, other

    def factors(self) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The offsets at which a repeated window begins, as bits of a number a row, and the factors (row, other, column, words)."""
        w, m = self.window, len(self.key)
        bits, reached = np.zeros(m, np.int64), self.begin.copy()
        found: list[tuple[int, int, int, int]] = []

        def span(rows: np.ndarray, q: np.ndarray, length: np.ndarray) -> None:
            some = np.maximum(length - w + 1, 0)
            bits[rows] |= ((np.int64(1) << some) - 1) << q

        rows = np.flatnonzero(self.copies)
        last = self.columns - w  # the anchor's column: later windows lack it
        stop = np.minimum(self.end, last + w)
        span(rows, self.begin[rows], stop[rows] - self.begin[rows])
        reached[rows] = self.columns
        for q in range(last + 1):
            whole = (self.begin <= q) & (q + w <= self.end)
            open_ = whole & (reached < q + w)
            if not open_.any():
                continue
            asked = np.zeros(self.group.max() + 1, bool)
            asked[self.group[open_]] = True
            rows = np.flatnonzero(whole & asked[self.group])
            rows = rows[np.bincount(self.group[rows], minlength=len(asked))[self.group[rows]] > 1]
            if not len(rows):
                continue
            length, other = self.longest(rows, q)
            hit = open_[rows] & (length >= w)
            r, n = rows[hit], length[hit]
            span(r, np.full(len(r), q), np.minimum(n, last + w - q))
            reached[r] = q + n
            found += zip(r.tolist(), other[hit].tolist(), [q] * len(r), n.tolist(), strict=True)
        return bits, found

    def confirmed(self, found: list[tuple[int, int, int, int]]) -> bool:
        """Whether all factors are equal word for word."""
        at, raw = self.bytes, self.raw
        for r, o, q, n in found:
            if raw[r][at[r, q] : at[r, q + n]] != raw[o][at[o, q] : at[o, q + n]]:
                return False
        return True


def repeated(table: pa.Table, window: int, gram: int) -> np.ndarray:
    """Bits of the columns at which each context's repeated windows begin."""
    ref = Reference(table, window, gram)
    bits, found = ref.factors()
    if not ref.confirmed(found):  # two words share a hash
        bits, _ = Reference(table, window, gram, exact=True).factors()
    return bits


def _factor(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, ROWS):
            bits = repeated(table, window, gram)
            keep = bits != 0
            if keep.any():
                rows = table.select(["key", "sid", "block"]).filter(pa.array(keep)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in rows.columns), pa.array(bits[keep])], names=["key", "sid", BLOCK, "bits"])

    return run


def _kept_words(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None) -> bytes:
    words = text.split()
    return b" ".join(words if gone is None else compress(words, (~gone).tolist()))


def _cut(text_col: str, window: int, gram: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.unique(right["key"].to_numpy().view(np.uint64))
        known = dict(zip(zip(right["key"].to_numpy().view(np.uint64).tolist(), right["sid"].to_pylist(), strict=True), right["bits"].to_pylist(), strict=True))
        offsets = np.arange(window - gram + 1)

        def cuts():
            for words in word_slices(left[text_col]):
                s = Seeds(words, window, gram)
                begin = [np.zeros(0, np.int64)]
                if len(s.starts) and len(keys):
                    c = _Contexts(s, window, gram)
                    at = s.anchors()
                    at = at[member(s.grams[at], keys)]
                    for key, (p, lead, x) in zip(s.grams[at].tolist(), c.around(at), strict=True):
                        bits = known.get((key, _sid(lead, x)), 0)
                        if bits:
                            begin.append(p - (window - gram) + offsets[bits >> offsets & 1 == 1])
                    names_ = window_names(s.hashes, window)[s.starts]
                    hit = member(names_, keys)
                    for key, (p, lead, x) in zip(names_[hit].tolist(), c.windows(s.starts[hit]), strict=True):
                        if known.get((key, _sid(lead, x)), 0):
                            begin.append(np.array([p]))
                yield words, cover(np.concatenate(begin), window, len(s.hashes))

        return rewritten(left, text_col, cuts(), _kept_words, names)

    return run


def rlz_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, blocks: int | None = None, hot: int = HOT
) -> DataFrame:
    """``docs`` with the kept words joined by one space, plus n_words and spans.

    ``spans``: word ranges [start, end) removed, in order.
    """
    gram = max(min(GRAM, min_words), min_words - 61)  # a context's offsets fit one number
    docs = docs.drop("n_words", "spans", BLOCK)
    x = dealt(docs, id_col, text_col, blocks)
    anchors = shared_anchors(x, text_col, min_words, gram, hot)
    sent = x.groupBy(BLOCK).cogroup(anchors.groupBy(BLOCK)).applyInArrow(_send(text_col, min_words, gram), "key long, sid long, block int, lead int, n int, words binary")
    hits = by_key(sent).mapInArrow(_factor(min_words, gram), f"key long, sid long, {BLOCK} int, bits long")
    schema = with_spans(x)
    return x.groupBy(BLOCK).cogroup(hits.groupBy(BLOCK)).applyInArrow(_cut(text_col, min_words, gram, schema.names[:-2]), schema)

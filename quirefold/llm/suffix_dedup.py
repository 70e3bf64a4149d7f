"""Passage dedup with sparse suffix arrays: of every run of ``min_words`` words that repeats, the first place stays.

1. The suffixes retained are those at minimiser positions (the anchors of
   ``blocks``) that are picked at two places or more.  A suffix goes on as the
   ``min_words`` words from its position on and, read backwards, the
   ``min_words - gram`` words before it; equal ones of a block go once, with
   their first place and their number.
2. Suffixes are dealt by their first ``gram`` words and sorted by their words:
   a suffix array in as many parts as there are partitions, with all suffixes
   of an anchor in a row.
3. Neighbours are compared word by word to the right; ordered by the words
   before them, they are compared to the left.  Suffixes that agree on r words
   to the right are a run of the first order without a smaller match between
   neighbours, those that agree on l words to the left a run of the second.
   A match of l words before and r from the suffix on is thus one of both
   runs, and every repeated run of ``min_words`` words is one for some l + r.
4. Of each such class the least place (id, position) stays.  What repeats goes
   back to the blocks as bits by offset, and the words of all other places are
   cut out; overlapping runs join, so longer passages go as a whole.

Words are compared as hashes and the matches of neighbours confirmed on the
words themselves; where that fails the part is compared again on its words.
An anchor with more than ``blocks.HOT`` places retains the suffix at each of
its windows instead, dealt by the whole window, so that no task meets an
unbounded group.

Results: null text stays null and has no words; shorter texts are left alone;
rows that repeat an id *and* a text are the same place and stay as the first
one does; rows with null ids are places of their own, before all others;
extra columns are carried along (those named as results are replaced); an
empty table gives no rows.  The text around a cut keeps its own spacing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.llm.arrays import mix, window_names, word_slices, words_hash
from quirefold.llm.blocks import BLOCK, HOT, Seeds, by_key, cover, dealt, gathered, member, normalised, rewritten, shared_anchors, spans_of, with_spans

GRAM = 8
#: Suffixes compared at a time.
ROWS = 8_000
_NULL = np.iinfo(np.int64).min
_SENT = {"key": pa.int64(), "sid": pa.int64(), "block": pa.int32(), "n": pa.int32(), "right": pa.binary(), "left": pa.binary(), "doc": pa.int64(), "row": pa.int64(), "pos": pa.int64()}
_FOUND = "key long, sid long, _block int, again long, first long, doc long, row long, pos long"


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Places:
    """(id, row) of the documents of a block: rows with an id are told apart by their texts, rows without by a number."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        ids = table[id_col].combine_chunks()
        texts = table[text_col].to_pylist()
        self.doc = ids.fill_null(_NULL).to_numpy()
        self.row = np.array([_digest((t or "").encode()) for t in texts], np.int64)
        nameless = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        block = table[BLOCK][0].as_py()
        for i, at in enumerate(sorted(nameless.tolist(), key=lambda i: texts[i] or "")):
            self.row[at] = block << 32 | i


class _Suffixes:
    """Retained suffixes of a slice: words to the right, words to the left read backwards, and places."""

    def __init__(self, s: Seeds, places: _Places, window: int, gram: int):
        self.s, self.places, self.window, self.before = s, places, window, window - gram
        self.text, self.at = normalised(s.words)
        back = self.text[:-1].split(b" ")[::-1]
        self.back = b" ".join(back) + b" "
        self.back_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in back])])

    def take(self, anchors: np.ndarray, left: bool = True) -> Iterator[tuple[int, bytes, bytes, tuple[int, int, int]]]:
        """(word, right, left, place) of the suffixes at these words."""
        first, n = self.s.words.first, len(self.s.hashes)
        doc = np.searchsorted(first, anchors, side="right") - 1
        right = self.at[np.minimum(first[doc + 1], anchors + self.window)]
        k = np.minimum(anchors - first[doc], self.before if left else 0)
        a, b = self.back_at[n - anchors], self.back_at[n - anchors + k]
        row = self.s.words.row + doc
        place = zip(self.places.doc[row].tolist(), self.places.row[row].tolist(), (anchors - first[doc]).tolist(), strict=True)
        text, back = self.text, self.back
        for p, x, y, u, v, where in zip(anchors.tolist(), self.at[anchors].tolist(), right.tolist(), a.tolist(), b.tolist(), place, strict=True):
            yield p, text[x:y], back[u:v], where


def _send(id_col: str, text_col: str, window: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in _SENT.items()})
        keys, hot = right["key"].to_numpy().view(np.uint64), right["hot"].to_numpy()
        warm, hot = np.sort(keys[~hot]), np.sort(keys[hot])
        places = _Places(left, id_col, text_col)
        found: dict[tuple[int, bytes, bytes], list] = {}
        for words in word_slices(left[text_col]):
            s = Seeds(words, window, gram)
            at = s.anchors()
            at = at[member(s.grams[at], warm)]
            starts = s.starts[member(s.grams[s.picked], hot)]
            if not len(at) and not len(starts):
                continue
            suffixes = _Suffixes(s, places, window, gram)
            both = [(s.grams[at], suffixes.take(at))]
            if len(starts):
                both.append((window_names(s.hashes, window)[starts], suffixes.take(starts, left=False)))
            for names, rows in both:
                for key, (_, x, y, where) in zip(names.tolist(), rows, strict=True):
                    have = found.get((key, x, y))
                    if have is None:
                        found[key, x, y] = [1, where]
                    else:
                        have[0] += 1
                        if where < have[1]:
                            have[1] = where
        values = [
            [k for k, _, _ in found], [_digest(x + b"\n" + y) for _, x, y in found], [left[BLOCK][0].as_py()] * len(found), [min(n, 2) for n, _ in found.values()],
            [x for _, x, _ in found], [y for _, _, y in found], *([where[i] for _, where in found.values()] for i in range(3)),
        ]
        values[0] = np.array(values[0], np.uint64).view(np.int64)
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(_SENT.items(), values, strict=True)})

    return run


class _Side:
    """Words of one side of the suffixes as a matrix; a missing word equals no other."""

    def __init__(self, raw: list[bytes], width: int):
        self.raw = raw
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])[: len(self.ends)]
        size = np.array([len(x) for x in raw], np.int64)
        self.base = np.cumsum(size) - size
        first = np.searchsorted(self.starts, self.base)
        self.count = np.diff(np.append(first, len(self.starts)))
        self.width, self.m = width, len(raw)
        self.row = np.repeat(np.arange(self.m), self.count)
        self.col = np.arange(len(self.starts)) - np.repeat(first, self.count)
        self.bytes = np.zeros((self.m, width + 1), np.int64)
        self.bytes[self.row, self.col + 1] = self.ends + 1 - self.base[self.row]

    def fill(self, ids: np.ndarray, free: int) -> None:
        self.cells = (free + np.arange(self.m * self.width)).reshape(self.m, self.width)
        self.cells[self.row, self.col] = ids

    def matches(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Words in which each suffix of the order agrees with the one before it; -1 if that is of another group."""
        c, g = self.cells[order], group[order]
        same = c[1:] == c[:-1]
        run = np.where(same.all(axis=1), self.width, same.argmin(axis=1)) if self.width else np.zeros(len(order) - 1, np.int64)
        return np.concatenate([[-1], np.where(g[1:] == g[:-1], run, -1)])

    def confirmed(self, order: np.ndarray, run: np.ndarray) -> bool:
        """Whether these matches are equal word for word."""
        some = np.flatnonzero(run > 0)
        a, b = order[some - 1], order[some]
        raw = self.raw
        return all(
            raw[i][:x] == raw[j][:y] for i, j, x, y in zip(a.tolist(), b.tolist(), self.bytes[a, run[some]].tolist(), self.bytes[b, run[some]].tolist(), strict=True)
        )


def compared(table: pa.Table, window: int, gram: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, bits of l (words to the left): where the run of l + r = ``window`` words repeats, and where it is the first.

    table: suffixes sorted by key and words.
    """
    sides = [_Side(table["right"].combine_chunks().to_pylist(), window), _Side(table["left"].combine_chunks().to_pylist(), window - gram)]
    if exact:
        names: dict[bytes, int] = {}
        ids = [np.array([names.setdefault(w, len(names)) for x in s.raw for w in x.split(b" ")[:-1]], np.int64) for s in sides]
    else:
        letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hashes = [words_hash(letters, s.data, s.starts, s.ends) for s in sides]
        _, flat = np.unique(np.concatenate(hashes), return_inverse=True)
        ids = [flat[: len(hashes[0])], flat[len(hashes[0]) :]]
    free = max((int(x.max()) + 1 for x in ids if len(x)), default=0)
    for s, x in zip(sides, ids, strict=True):
        s.fill(x, free)
    right, left = sides
    m = len(right.raw)
    _, group = np.unique(table["key"].to_numpy(), return_inverse=True)
    rows = np.arange(m)
    run_r = right.matches(rows, group)
    k = np.concatenate([group[:, None], left.cells], axis=1).astype(">u4")
    order = np.argsort(np.ascontiguousarray(k).view(f"S{4 * k.shape[1]}").ravel(), kind="stable")
    run_l = left.matches(order, group)
    if not exact and not (right.confirmed(rows, run_r) and left.confirmed(order, run_l)):
        return compared(table, window, gram, exact=True)
    most_r = np.maximum(run_r, np.append(run_r[1:], -1))
    most_l = np.empty(m, np.int64)
    most_l[order] = np.maximum(run_l, np.append(run_l[1:], -1))
    copies = table["n"].to_numpy()
    place = np.lexsort(tuple(table[c].to_numpy() for c in ("pos", "row", "doc")))
    rank = np.empty(m, np.int64)
    rank[place] = rows
    again, first = np.zeros(m, np.int64), np.zeros(m, np.int64)
    to_left = np.empty(m, np.int64)
    for l in range(window - gram + 1):  # noqa: E741
        r = window - l
        at = np.flatnonzero((left.count >= l) & (right.count >= r) & ((copies > 1) | ((most_r >= r) & (most_l >= l))))
        if not len(at):
            continue
        to_left[order] = np.cumsum(run_l < l)
        pair = np.cumsum(run_r < r)[at] << 32 | to_left[at]
        o = np.lexsort((rank[at], pair))
        head = np.flatnonzero(np.concatenate([[True], pair[o][1:] != pair[o][:-1]]))
        size = np.diff(np.append(head, len(o)))
        twice = np.add.reduceat(copies[at[o]], head) > 1
        again[at[o[np.repeat(twice, size)]]] |= np.int64(1) << l
        first[at[o[head[twice]]]] |= np.int64(1) << l
    return again, first


def _compare(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, ROWS):
            again, first = compared(table, window, gram)
            keep = again != 0
            if keep.any():
                rows = table.drop_columns(["n", "right", "left"]).filter(pa.array(keep)).combine_chunks()
                key, sid, block, *place = (c.chunk(0) for c in rows.columns)
                yield pa.RecordBatch.from_arrays([key, sid, block, pa.array(again[keep]), pa.array(first[keep]), *place], names=["key", "sid", BLOCK, "again", "first", "doc", "row", "pos"])

    return run


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None) -> bytes:
    if gone is None:
        return text
    out, at = [], 0
    for a, b in zip(*(x.tolist() for x in spans_of(gone)), strict=True):
        out.append(text[at : int(starts[a])])
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    return b"".join([*out, text[at:]])


def _cut(id_col: str, text_col: str, window: int, gram: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.unique(right["key"].to_numpy().view(np.uint64))
        columns = [right["key"].to_numpy().view(np.uint64).tolist(), *(right[c].to_pylist() for c in ("sid", "again", "first", "doc", "row", "pos"))]
        known = {(key, sid): (again, first, where) for key, sid, again, first, *where in zip(*columns, strict=True)}
        places = _Places(left, id_col, text_col) if len(left) else None
        offsets = np.arange(window - gram + 1)

        def cuts():
            for words in word_slices(left[text_col]):
                s = Seeds(words, window, gram)
                begin = [np.zeros(0, np.int64)]
                if len(s.starts) and len(keys):
                    suffixes = _Suffixes(s, places, window, gram)
                    at = s.anchors()
                    at = at[member(s.grams[at], keys)]
                    windows = window_names(s.hashes, window)[s.starts]
                    hit = member(windows, keys)
                    for found, rows in ((s.grams[at], suffixes.take(at)), (windows[hit], suffixes.take(s.starts[hit], left=False))):
                        for key, (p, x, y, where) in zip(found.tolist(), rows, strict=True):
                            again, first, home = known.get((key, _digest(x + b"\n" + y)), (0, 0, None))
                            if first and home == list(where):
                                again &= ~first
                            if again:
                                begin.append(p - offsets[again >> offsets & 1 == 1])
                yield words, cover(np.concatenate(begin), window, len(s.hashes))

        return rewritten(left, text_col, cuts(), _without, names)

    return run


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, blocks: int | None = None, hot: int = HOT
) -> DataFrame:
    """``docs`` with repeated passages cut from the text, plus n_words and spans (word ranges cut)."""
    gram = max(min(GRAM, min_words), min_words - 61)  # a suffix's offsets fit one number
    docs = docs.drop("n_words", "spans", BLOCK)
    x = dealt(docs, id_col, text_col, blocks)
    anchors = shared_anchors(x, text_col, min_words, gram, hot)
    schema = "key long, sid long, block int, n int, right binary, left binary, doc long, row long, pos long"
    sent = x.groupBy(BLOCK).cogroup(anchors.groupBy(BLOCK)).applyInArrow(_send(id_col, text_col, min_words, gram), schema)
    hits = by_key(sent, "right", "left").mapInArrow(_compare(min_words, gram), _FOUND)
    out = with_spans(x)
    return x.groupBy(BLOCK).cogroup(hits.groupBy(BLOCK)).applyInArrow(_cut(id_col, text_col, min_words, gram, out.names[:-2]), out)

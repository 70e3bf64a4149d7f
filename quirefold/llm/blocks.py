"""Documents dealt to blocks of bounded bytes, and the seeds that blocks share.

A window is a run of ``window`` consecutive words of one document; its anchor
is the least hash of the ``gram``-word runs in it, the leftmost of equals.
Equal windows have equal anchors at equal offsets, so a window that occurs
twice has an anchor that is picked at two places or more.  ``shared_anchors``
finds those: each block lists the anchors it picks, once each with their
number of places, and one shuffle adds the numbers up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.arrays import Words, sliding_argmin, window_names, window_starts, word_slices
from quirefold.session import shuffle_partitions

BLOCK = "_block"
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of text in a block and in a partition.
BLOCK_BYTES, PART_BYTES = 16 << 20, 128 << 20
#: Places of an anchor beyond which its windows are told apart one by one.
HOT = 20_000
_MOST = (1 << 30) - 1


def block_counts(docs: DataFrame, text_col: str, blocks: int | None = None) -> tuple[int, int]:
    """Numbers of blocks and of partitions: both follow the bytes of text, and are the session's shuffle partitions at least."""
    if blocks:
        return blocks, blocks
    n = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(n, -(-size // BLOCK_BYTES)), max(n, -(-size // PART_BYTES))


def dealt(docs: DataFrame, id_col: str, text_col: str, blocks: int | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """Documents dealt to blocks by a hash of id and text (null ids and copies spread).

    A partition holds several blocks.  counts: ``block_counts``, if known.
    """
    n, parts = counts or block_counts(docs, text_col, blocks)
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    return docs.withColumn(BLOCK, key).repartition(parts, BLOCK)


class Seeds:
    """The windows of a slice of texts and their anchors.

    starts: words that begin a window; picked: the anchor's word for each;
    grams: hash of the run at each word.
    """

    def __init__(self, words: Words, window: int, gram: int):
        self.words = words
        self.hashes = words.hashes()
        self.starts = np.flatnonzero(window_starts(words.first, window, len(self.hashes)))
        self.grams, self.picked = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.starts):
            self.grams = window_names(self.hashes, gram)
            self.picked = sliding_argmin(self.grams, window - gram + 1)[self.starts]

    def anchors(self) -> np.ndarray:
        """Words at which an anchor lies, in order."""
        if not len(self.picked):
            return self.picked
        new = np.ones(len(self.picked), bool)
        new[1:] = self.picked[1:] != self.picked[:-1]
        return self.picked[new]


def normalised(words: Words) -> tuple[bytes, np.ndarray]:
    """All words of a slice, each followed by one blank, and where each begins."""
    data = words.data.tobytes()
    at = words.offsets.tolist()
    parts = [b" ".join(data[a:b].split()) for a, b in zip(at[:-1], at[1:], strict=True)]
    text = b" ".join([p for p in parts if p]) + b" "
    return text, np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])


def _anchors(text_col: str, window: int, gram: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for words in word_slices(table[text_col]):
            s = Seeds(words, window, gram)
            found.append(s.grams[s.anchors()])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        block = table[BLOCK][0].as_py() if len(table) else 0
        return pa.table({"key": keys.view(np.int64), "rest": np.int64(block) << 30 | np.minimum(n, _MOST)})

    return run


def _shared(hot: int):
    """From rows sorted by key, those of keys with two places or more; the last key waits for the next batch."""

    def done(key: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(heads, len(key)))
            total = np.repeat(np.add.reduceat(rest & _MOST, heads), size)
            keep = total >= 2
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(total[keep] > hot), pa.array((rest[keep] >> 30).astype(np.int32))], names=["key", "hot", BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, rest = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([rest, batch.column("rest").to_numpy()])
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))  # rows of the open key: one a block
                yield from done(key[:cut], rest[:cut])
                key, rest = key[cut:], rest[cut:]
        yield from done(key, rest)

    return run


def shared_anchors(x: DataFrame, text_col: str, window: int, gram: int, hot: int = HOT) -> DataFrame:
    """(key, hot, block): anchors of ``dealt`` documents with two places or more, for each block that has them; hot: with more than that many."""
    rows = x.groupBy(BLOCK).applyInArrow(_anchors(text_col, window, gram), "key long, rest long")
    return by_key(rows).mapInArrow(_shared(hot), f"key long, hot boolean, {BLOCK} int")


def by_key(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", *order)


def member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array wanted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole keys of a stream sorted by key, about ``rows`` rows at a time (more only if one key has more)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = len(table) - cut
    if count:
        yield pa.Table.from_batches(held)


def spans_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Words covered by the windows at ``starts``."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def rewritten(table: pa.Table, text_col: str, cuts: Iterator[tuple[Words, np.ndarray]], rewrite: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray | None], bytes], names: list[str]) -> pa.Table:
    """A block's rows with new texts, n_words and spans.

    cuts: slices of words with what is cut of them; rewrite(text, starts and
    ends of its words in bytes, what is cut or None).
    """
    null = table[text_col].is_null().to_numpy()
    texts, counts, starts, ends, sizes = [], [], [], [], [0]
    for words, cut in cuts:
        data = words.data.tobytes()
        for i, c in enumerate(words.counts.tolist()):
            o, e = int(words.offsets[i]), int(words.offsets[i + 1])
            w = slice(int(words.first[i]), int(words.first[i]) + c)
            gone = cut[w]
            a, b = spans_of(gone)
            counts.append(c)
            starts.extend(a.tolist())
            ends.extend(b.tolist())
            sizes.append(len(starts))
            texts.append(None if null[words.row + i] else rewrite(data[o:e], words.starts[w] - o, words.ends[w] - o, gone if len(a) else None))
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"])
    out = {c: table[c] for c in names if c != text_col}
    out |= {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)}
    return pa.table({c: out[c] for c in [*names, "n_words", "spans"]})


def with_spans(x: DataFrame) -> T.StructType:
    """Schema of ``rewritten``."""
    return T.StructType([*x.drop(BLOCK).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])

"""Phrases of any number found in texts by hashed word runs.

For each length that occurs among the phrases a text's word runs of that
length are named by a hash, and those whose name no phrase has are left out
where they are, by a bitmap of the names.  The rest, the hits and few others,
are joined to the phrases on (length, hash); the words themselves are compared
in the same join.  A phrase list that Spark knows to be small is broadcast by
its own size check, any other is shuffled, where adaptive execution splits the
runs of a frequent phrase.  No worker needs the whole list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.pieces import arrow_udf

WORD = r"[\p{L}\p{N}]+"
#: More different lengths than this are refused: each adds a pass over the words.
LENGTHS = 64
#: Bits of the bitmap for each phrase (to the next power of 2, at most 2 MB); more phrases than this have none, and all runs are joined.
PLACES, MOST_BITS, MOST_PHRASES = 128, 24, 1 << 22
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RUN = pa.struct([("start", pa.int32()), ("length", pa.int32())])


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def prepared(terms: DataFrame, term: str = "term") -> DataFrame:
    """(length, hash, term_words): the different phrases; those without a word are left out."""
    t = terms.select(words(F.col(term)).alias("term_words")).where("size(term_words) > 0").distinct()
    return t.select(F.size("term_words").alias("length"), F.xxhash64("term_words").alias("hash"), "term_words")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _named(hashes: pa.Array, lengths: list[int], bits: int):
    """For each length the places in the bitmap of the runs at all words, and the words at which a run of one text begins."""
    flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.fromiter((n or 0 for n in hashes.value_lengths().to_pylist()), np.int64, len(hashes))
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the text's end
    name, n = flat, 1
    for k in lengths:
        while n < k:
            name, n = name[:-1] * _FACTOR + flat[n:], n + 1
            if not len(name):
                return
        yield k, ((name + np.uint64(k)) * _SPREAD) >> np.uint64(64 - bits), room[: len(name)] >= k


def _bitmap(known: DataFrame, lengths: list[int], bits: int) -> np.ndarray:
    def places(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), np.int32)
        starts = np.cumsum([0, *words.value_lengths().to_pylist()])
        for k, at, _ in _named(words, lengths, bits):
            mine = np.flatnonzero(np.diff(starts) == k)
            out[mine] = at[starts[mine]]
        return pa.array(out)

    found = known.select(arrow_udf(places, "int")(_hashes(F.col("term_words"))).alias("p")).toArrow()
    marked = np.zeros(1 << bits, bool)
    marked[found.column("p").to_numpy()] = True
    return np.packbits(marked)


def _likely(hashes: Column, lengths: list[int], bits: int, marked: np.ndarray | None) -> Column:
    """Array of (start, length): the runs whose place in the bitmap is marked, among them all that are phrases."""

    def run(hashes: pa.Array) -> pa.Array:
        row_of = np.repeat(np.arange(len(hashes)), np.fromiter((n or 0 for n in hashes.value_lengths().to_pylist()), np.int64, len(hashes)))
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k, at, whole in _named(hashes, lengths, bits):
            if marked is not None:
                at = at.astype(np.int64)
                whole = whole & ((marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            mine = np.flatnonzero(whole)
            starts.append(mine)
            sizes.append(np.full(len(mine), k, np.int32))
        start, size = np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
        rows = row_of[start]
        first = np.searchsorted(row_of, rows)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(hashes)))])
        runs = pa.StructArray.from_arrays([pa.array((start - first).astype(np.int32)), pa.array(size)], fields=list(_RUN))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)

    # else a filter on the result may run it a second time
    return arrow_udf(run, "array<struct<start:int,length:int>>").asNondeterministic()(hashes)


def hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term: str = "term") -> DataFrame:
    """(id, start, length, term): every place of every phrase, by word number from 0; repeated rows count again."""
    known = prepared(terms, term)
    numbers = {r.length: r["count"] for r in known.groupBy("length").count().limit(LENGTHS + 1).collect()}
    lengths, total = sorted(numbers), sum(numbers.values())
    if len(lengths) > LENGTHS:
        raise ValueError(f"phrases of more than {LENGTHS} different lengths")
    if not lengths:
        return texts.where("false").select(id_col, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("term"))
    w = texts.select(id_col, words(F.col(text_col)).alias("_w"))

    bits = min(MOST_BITS, (total * PLACES).bit_length())
    marked = _bitmap(known, lengths, bits) if total <= MOST_PHRASES else None
    w = w.withColumn("_likely", _likely(_hashes(F.col("_w")), lengths, bits, marked))
    runs = F.transform("_likely", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("n"), F.slice("_w", r["start"] + 1, r["length"]).alias("run")))
    found = w.select(id_col, F.explode(runs).alias("_r")).select(id_col, F.col("_r.start").alias("start"), F.col("_r.n").alias("_n"), F.col("_r.run").alias("_run"))
    found = found.withColumn("_h", F.xxhash64("_run"))
    out = found.join(known, (F.col("_n") == F.col("length")) & (F.col("_h") == F.col("hash")) & (F.col("_run") == F.col("term_words")))
    return out.select(id_col, "start", "length", F.array_join("term_words", " ").alias("term"))


def _kept(starts: pa.Array, lengths: pa.Array) -> pa.Array:
    """Of hits sorted by (start, -length): the places in the list of those that begin at or after the last one's end."""
    out = []
    for ss, ns in zip(starts.to_pylist(), lengths.to_pylist(), strict=True):
        end, mine = 0, []
        for i, (s, n) in enumerate(zip(ss, ns, strict=True)):
            if s >= end:
                mine.append(i)
                end = s + n
        out.append(mine)
    return pa.array(out, pa.list_(pa.int32()))


def leftmost_longest(found: DataFrame, id_col: str) -> DataFrame:
    """Hits without overlap: from the left, at one start the longest; a text's hits meet in its row."""
    kept = F.arrow_udf(_kept, "array<int>")
    first = found.groupBy(id_col, "start").agg(F.max_by(F.struct("length", "term"), "length").alias("h"))
    rows = first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "h.length", "h.term"))).alias("_h"))
    picked = rows.withColumn("_k", kept(F.col("_h.start"), F.col("_h.length")))
    return picked.select(id_col, F.explode(F.transform("_k", lambda i: F.element_at("_h", i + 1))).alias("h")).select(id_col, "h.*")

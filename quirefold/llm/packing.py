"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become token ids plus an end id.  Only documents longer than the
sequence length are cut; their full pieces fill sequences of their own, so at
most one shorter piece of each document is left to pack.

Bulk-synchronous best fit, in rounds over two tables, pieces and gaps:

1. Pieces and gaps are range-sorted together by size, largest first, a gap
   before the pieces of its own size.
2. A sweep gives every piece its successor, the smallest gap before it that is
   still free: with gaps as opening and pieces as closing brackets, partners
   have the same nesting level.  Each range sums its own brackets, the sums of
   the ranges before it are added, and rows meet by level; a level is crossed
   at most twice a size, so no group grows with the data.
3. Pieces that want the same gap are told apart by their rank in the sweep:
   the first takes it, the next one the gap before, and so on.
4. Gaps shrink by what they took, and the next round begins with the pieces
   left over.  A gap of several times the largest piece left takes part as
   several slots of equal size.

Pieces of over half the length open a sequence each; later on, pieces larger
than every gap open as many as their tokens fill.  The driver sees counts of
lengths and of ranges, and how many sequences to open; places are decided in
the sweeps.

Null text: an empty document (the end id alone).  Repeated rows are packed
one by one.  Ties in size are broken by a hash of the piece's row.  An empty
table gives no rows.  Columns other than id and text take no part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import materialize, release, shuffle_partitions

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Rows in a range of a sweep.
RANGE = 20_000
#: Sequences that hold no piece of over half the length are numbered from here on.
OPENED = 1 << 62

def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_encoders: dict[str, object] = {}


def encoder(path: str | None):
    """The byte-level BPE of a tokenizers file, as ranks (kept by each worker)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = {c: b for b, c in byte_letters().items()}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged[:-1], merged[1:], strict=True)):
            raise ValueError("ids do not follow the order of merges")
        ranks = {bytes(letters[c] for c in t): i for t, i in ids.items()}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


_whole: dict[str, object] = {}


def ids_of(enc, text: str, path: str | None) -> np.ndarray:
    """Ids of a whole text; the library itself takes those on which the fast encoder's pattern gives up."""
    try:
        return enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:  # a run of blanks too long for its backtracking
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
        if path not in _whole:
            _whole[path] = Tokenizer.from_file(path)
            _whole[path].no_padding()
            _whole[path].no_truncation()
        return np.array(_whole[path].encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(size: int, end_id: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(ids_of(enc, text or "", path), end_id).astype("<u4")
                a, b, k = 0, (len(ids) - 1) % size + 1, 0
                while a < len(ids):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    a, b, k = b, b + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"],
            )

    return run


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range with the range's number, their place in it, and their nesting level counted from its start."""
    part, open_, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column("piece").to_numpy(zero_copy_only=False)
        balance = open_ + np.cumsum(np.where(piece, -1, 1))
        at = rows + np.arange(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at), pa.array(balance + piece)],
            names=["size", "piece", "key", "slot", "part", "at", "level"],
        )
        open_, rows = int(balance[-1]), rows + batch.num_rows


def sweep(pieces: DataFrame, slots: DataFrame, rows: int) -> DataFrame:
    """Pieces (key, length) with the slot (seq, slot) each one gets; null where none is left.

    slots: (seq, slot, size); rows: of both tables together.
    """
    spark = pieces.sparkSession
    n = max(1, min(shuffle_partitions(spark), rows // RANGE + 1))
    items = slots.select("size", F.lit(False).alias("piece"), F.col("seq").alias("key"), "slot").unionByName(
        pieces.select(F.col("length").alias("size"), F.lit(True).alias("piece"), "key", F.lit(0).alias("slot"))
    )
    order = [F.desc("size"), F.asc("piece"), F.xxhash64("key", "slot")]
    ranges = items.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranges = materialize(ranges.mapInArrow(_swept, "size long, piece boolean, key long, slot int, part int, at long, level long"), "ranges")
    sums = ranges.groupBy("part").agg(F.sum(F.when(F.col("piece"), -1).otherwise(1)).alias("sum")).collect()  # a row a range
    before, opened = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before.append((r["part"], opened))
        opened += r["sum"]
    levels = ranges.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").withColumn("level", F.col("level") + F.col("before"))
    w = Window.partitionBy("level").orderBy("part", "at")
    mate = F.lag(F.struct("piece", "key", "slot")).over(w)
    paired = levels.withColumn("mate", mate).where("piece")
    taken = lambda c: F.when(~F.col("mate.piece"), F.col(f"mate.{c}"))
    out = materialize(paired.select("key", F.col("size").alias("length"), taken("key").alias("seq"), taken("slot").alias("slot")), "matched")
    release(ranges)
    return out


def best_fit(pieces: DataFrame, size: int) -> DataFrame:
    """(key, seq, offset) of pieces (key, length), each shorter than ``size``."""
    spark = pieces.sparkSession
    histogram = lambda df: {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    alone, rest = pieces.where(2 * F.col("length") > size), pieces.where(2 * F.col("length") <= size)
    placed = [alone.select("key", F.col("key").alias("seq"), F.lit(0).alias("slot"), "length", F.lit(0).alias("round"))]
    gaps, owned, opened = alone.select(F.col("key").alias("seq"), (size - F.col("length")).alias("room")), None, OPENED
    left = histogram(rest)  # at most ``size`` rows
    while left:
        most, count = gaps.agg(F.coalesce(F.max("room"), F.lit(0)), F.count("*")).first()
        over = {x: n for x, n in left.items() if x > most}
        if over:
            new = -(-sum(x * n for x, n in over.items()) // size)
            gaps, opened, count = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("room"))), opened + new, count + new
        waiting = sum(left.values())
        fair = -(-4 * waiting // count)
        k = F.least(F.greatest(F.floor(F.col("room") / max(left)), F.lit(1)), F.lit(fair)).cast("int")
        slots = gaps.withColumn("k", k).select("seq", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slot"), F.floor(F.col("room") / F.col("k")).alias("size"))
        matched = sweep(rest, slots, waiting + 2 * count)
        got = matched.where("seq is not null").select("key", "seq", "slot", "length", F.lit(len(placed)).alias("round"))
        placed.append(got)
        rest = matched.where("seq is null").select("key", "length")
        left = histogram(rest)
        # gaps below the least piece left are of no more use
        used = got.groupBy("seq").agg(F.sum("length").alias("used"))
        shrunk = gaps.join(used, "seq", "left").select("seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        gaps = materialize(shrunk.where(F.col("room") >= min(left, default=size)), "gaps")
        if owned is not None:
            release(owned)
        owned = gaps
    before = F.sum("length").over(Window.partitionBy("seq").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1))
    return reduce(DataFrame.unionByName, placed).select("key", "seq", F.coalesce(before, F.lit(0)).alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    vocabulary: a tokenizers file of a byte-level BPE on every executor
    (default: the installed byte_bpe_50k.json).
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    cut = source.mapInArrow(_pieces(size, end_id, vocabulary), f"id {kind}, piece int, start long, length long, crc long")
    pieces = materialize(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    part = pieces.where(F.col("length") < size)
    packed = part.join(best_fit(part.select("key", "length"), size), "key").drop("key")
    full = pieces.where(F.col("length") == size).select("*", (-1 - F.col("key")).alias("seq"), F.lit(0).cast("long").alias("offset")).drop("key")
    return packed.unionByName(full).select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("seq").alias("sequence_id"), "offset"
    )

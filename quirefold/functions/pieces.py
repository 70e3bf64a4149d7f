"""Python steps over pieces of Arrow batches.

Spark hands a worker batches of up to 10,000 rows (and 64 MB by default).  The
Python objects of a whole batch and of its results take many times that, so
steps go over a batch in pieces, of few rows and few bytes, and give each
piece's results away at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a piece at most, and its bytes; a row of more bytes is a piece of its own.
ROWS, BYTES = 64, 1 << 20


def _halved(part: tuple) -> Iterator[tuple]:
    """Columns of a few rows (or a batch alone) in halves, until each is of one row or within the bytes."""
    n = len(part[0])
    if n > 1 and sum(c.nbytes for c in part) > BYTES:
        yield from _halved(tuple(c.slice(0, n // 2) for c in part))
        yield from _halved(tuple(c.slice(n // 2) for c in part))
    else:
        yield part


def _cut(whole: tuple) -> Iterator[tuple]:
    for i in range(0, len(whole[0]), ROWS):
        yield from _halved(tuple(c.slice(i, ROWS) for c in whole))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order."""
    for batch in batches:
        for (piece,) in _cut((batch,)):
            yield piece


def arrow_udf(f: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """``F.arrow_udf`` of a function of arrays, which gets a piece of them at a time."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in _cut(batch if isinstance(batch, tuple) else (batch,)):
                yield f(*piece)

    return F.arrow_udf(run, kind)

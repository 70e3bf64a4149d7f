"""Word and hash arrays over batches of texts.

Small helpers that run inside Spark tasks: a batch of UTF-8 texts becomes one
byte array, words are found with a lookup table, and words and word runs are
hashed in a few passes over the bytes.  A word's hash gives every place in it
a multiplier of its own, so words that only swap or repeat parts (Thue-Morse
words, say) hash apart.

Null texts count as empty.  Words are maximal runs of bytes other than
space and 0x09-0x0D; UTF-8 keeps those bytes out of longer characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]

#: Texts are processed in slices of about this many bytes.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i modulo 2**64 for i < n (kept between calls)."""
    have = _powers.get(mult)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1024)
        out = []
        for m in (mult, pow(mult, -1, 1 << 64)):
            p = np.full(size, m, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 2 * SLICE:
            _powers[mult] = have
    return have


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each run, whatever its place; for short runs of well-mixed values."""
    power, inverse = powers(_MULT, len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


#: An odd random multiplier for each of the first places in a word.
_FACTORS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)
#: Bytes hashed at a time, so that the working arrays stay small.
_STEP = 1 << 18


def words_hash(letters: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word data[start:end] (bytes; no word is empty), with 64-bit codes for the letters."""
    size = ends - starts
    head = np.cumsum(size) - size
    total, longest = int(size.sum()), int(size.max(initial=0))
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, total, _STEP):
        high = min(total, low + _STEP)
        a, b = int(np.searchsorted(head, low, side="right")) - 1, int(np.searchsorted(head, high))
        begin = np.maximum(head[a:b], low)
        n = np.minimum(head[a:b] + size[a:b], high) - begin
        place = np.arange(low, high) - np.repeat(head[a:b], n)
        if longest <= len(_FACTORS):
            factor = _FACTORS[place]
        else:
            factor = mix((place + 1).astype(np.uint64) * np.uint64(_MULT)) | np.uint64(1)
        out[a:b] += np.add.reduceat(letters[data[place + np.repeat(starts[a:b], n)]] * factor, begin - low)
    return mix(out)


class Words:
    """The words of a slice of texts.

    data: bytes; offsets: text i is data[offsets[i]:offsets[i+1]];
    starts, ends: bytes of each word; first: words of text i are
    first[i]:first[i+1]; row: the first text's row in its batch.
    """

    __slots__ = ("data", "ends", "first", "offsets", "row", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int = 0):
        self.data, self.offsets, self.row = data, offsets, row
        word = ~SPACES[data]
        begin, last = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] = word[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = word[tails]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        table = _BYTES_LOWER if lower else _BYTES
        return words_hash(table, self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows at all
        column = pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def word_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Words]:
    """The words of a text column, in slices of whole texts of about ``limit`` bytes."""
    raw, at = byte_view(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield Words(raw[at[row] : at[stop]], at[row : stop + 1] - at[row], row)
        row = stop


def window_names(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, text ends ignored, by doubling: runs of 1, 2, 4, .. and their overlap."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    x, span = words, 1
    join = lambda a, b: mix(a * np.uint64(_MULT) + (b ^ (b >> np.uint64(31))))
    while span * 2 <= size:
        x = join(x[:-span], x[span:])
        span *= 2
    return join(x[: len(words) - size + 1], x[size - span :][: len(words) - size + 1]) if span < size else x


def window_starts(first: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which word positions start a whole window inside their text."""
    ok = np.zeros(max(0, n_words - size + 1), dtype=bool)
    counts = np.diff(first)
    for a, c in zip(first[:-1][counts >= size].tolist(), counts[counts >= size].tolist(), strict=True):
        ok[a : a + c - size + 1] = True
    return ok


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of values[i:i+width], compared by the top 40 bits."""
    if len(values) >= 1 << 24:  # places fit 24 bits: very long texts go in overlapping parts
        step = 1 << 23
        parts = [a + sliding_argmin(values[a : a + step + width - 1], width) for a in range(0, len(values) - width + 1, step)]
        return np.concatenate(parts)
    packed = (values & ~np.uint64((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    if span < width:
        packed = np.minimum(packed[: len(packed) - (width - span)], packed[width - span :])
    return (packed & np.uint64((1 << 24) - 1)).astype(np.int64)

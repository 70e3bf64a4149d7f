"""LM scoring with a probabilistic suffix tree over words.

Tokens are a text's words (A-Z in lower case) and one end token.  The root
holds the distribution of all training tokens: absolute discounting, with the
discounted mass (n1 / (n1 + 2 n2) for each distinct token) spread evenly over
the unseen tokens, whose number is estimated as n1 (n1 - 1) / (2 (n2 + 1))
(n1, n2: tokens seen once and twice) and is one at least.  So the model sums
to one over the known and that many unknown tokens.

The tree grows by length.  A context of ``d`` tokens is a candidate if it
occurs ``min_context`` times; its next tokens are those that follow it
``min_entry`` times, and all others count as one symbol.  It is retained if
this distribution diverges from that of the context one token shorter: the
likelihood-ratio statistic exceeds its chi-squared limit and the divergence
``min_nats`` a token.  A retained context gives each of its next tokens the
discounted share and hands the rest of its mass to the shorter context; a
context that is not retained passes the shorter one's distribution through.
Scoring thus takes the longest retained suffix of what came before.

Both minimum counts are absolute, so contexts, next tokens and token counts
all grow with the corpus.  None of them is collected or broadcast.  For each
length, a block of documents sends every distinct run of tokens that can still
reach the minima (its two shorter runs do) once with its count, and each
context it met with sums over its next tokens (each told by one of the blocks
that hold it).  Runs and contexts go to buckets, which are ranges of their
hashes, one for each block's worth of text: one row carries all that a block has
for a bucket, as differences of sorted hashes in as few bytes as they need.  The
bucket adds up, tests its contexts, and sends each block its own surviving
runs and retained contexts in the same form.  A frequent run is one entry a
block in its bucket.  The documents are read and dealt anew for each length,
which costs no disk beyond one shuffle at a time; ``docs`` should thus be a
stored table (or a plan that gives the same rows each time).

Results: a null or empty text is the end token alone.  Repeated rows are
scored (and learned from) one by one.  A null training flag is false.  Without
training rows every token is unknown and has probability one in the model.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.arrays import Words, mix, word_slices
from quirefold.llm.blocks import BLOCK, BLOCK_BYTES, block_counts, dealt
from quirefold.session import materialize

DEPTH = 3
MIN_CONTEXT = 16
MIN_ENTRY = 4
MIN_NATS = 0.02
_END = np.uint64(0xE0D0C0B0A0908071)
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Rows that carry the number of runs seen once and twice, of all runs and of their tokens, in place of a block.
_SUMS = _ONCE, _TWICE, _KINDS, _TOTAL = -1, -2, -3, -4
#: What blocks get, a row for each bucket: hashes of runs or of retained contexts; counts of runs, which of them this
#: block tells, weights of the shorter contexts.  rare: runs below the minimum.
_TABLE = f"level int, context boolean, rare boolean, {BLOCK} int, first long, keys binary, n binary, own binary, back binary"
#: What blocks send to a bucket: counts of runs, or totals of contexts and sums over their next tokens.
_SENT = f"bucket int, {BLOCK} int, context boolean, first long, keys binary, n binary, kinds binary, seen binary, fit binary, mass binary"


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers, byte by byte of all of them, without the high bytes that all lack."""
    v = np.ascontiguousarray(values, dtype="<u8")
    size = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + v.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted hashes (one at least): the first as a signed number, and the differences."""
    return int(keys[:1].view(np.int64)[0]), _packed(np.diff(keys, prepend=keys[:1]))


def _unpacked_keys(first: int, data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64) + np.array([first], np.int64).view(np.uint64)


def _rows(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


@dataclass
class Level:
    """Minima and what is known of each length's runs; discounts[0] is the root's."""

    min_context: int
    min_entry: int
    tokens: int = 0
    known: int = 0
    unseen: float = 1.0
    discounts: tuple[float, ...] = ()

    def root(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, (counts - self.discounts[0]) / self.tokens, self.discounts[0] * self.known / self.tokens / self.unseen)


class _Tokens:
    """Token hashes of a slice, each text's end token included."""

    def __init__(self, words: Words):
        n = words.counts + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.hash = np.empty(self.first[-1], np.uint64)
        ends = self.first[1:] - 1
        inner = np.ones(len(self.hash), bool)
        inner[ends] = False
        self.hash[inner] = words.hashes(lower=True)
        self.hash[ends] = _END
        self.place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], n)
        self.row = words.row


class _Tables:
    """A block's share of the tables: sorted hashes of runs and of retained contexts, by level."""

    def __init__(self, table: pa.Table):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = defaultdict(lambda: none)
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}
        for r in table.to_pylist():
            keys = _unpacked_keys(r["first"], r["keys"])
            if r["context"]:
                values = (np.frombuffer(r["back"], np.float64),)
            else:
                values = _unpacked(r["n"]).astype(np.int64), np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(keys)).astype(bool)
            held.setdefault((r["level"], r["context"]), []).append((keys, *values))
        for (d, which), rows in held.items():
            keys, *values = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            (self.contexts if which else self.runs)[d] = (keys[order], *(v[order] for v in values))
        self.run_index = defaultdict(lambda: _Index(none[0]), {d: _Index(x[0]) for d, x in self.runs.items()})
        self.context_index = {d: _Index(x[0]) for d, x in self.contexts.items()}


class _Index:
    """Finds hashes among sorted ones by their high bits: a step or two each."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes, -1 where there is none."""
        out = np.full(len(wanted), -1)
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], wanted[live]
        while len(live):
            have = self.keys[at]
            hit = have == wanted
            out[live[hit]] = at[hit]
            at += 1
            more = np.flatnonzero((have < wanted) & (at < end))
            live, at, end, wanted = live[more], at[more], end[more], wanted[more]
        return out


class _Runs:
    """Runs of 1, 2, .. tokens ending at each token of a slice, with their counts as far as the tables go.

    At token i: names[d] the run of d + 1 tokens; counts[d] how often it
    occurs, 0 if rarer than the minimum; at[d] its place in the table.
    """

    def __init__(self, t: _Tokens, tables: _Tables, known: Level, levels: int):
        self.t, self.tables, self.known = t, tables, known
        self.names, self.counts, self.at = [t.hash], [], []
        for d in range(levels):
            if d:
                self.names.append(self.next_names(d))
            at = np.full(len(t.hash), -1)
            where = self.candidates(d) if d else np.arange(len(t.hash))
            n = tables.runs[d][1]
            at[where] = tables.run_index[d].find(self.names[d][where])
            self.at.append(at)
            self.counts.append(np.where(at >= 0, n[at] if len(n) else 0, 0))

    def next_names(self, d: int) -> np.ndarray:
        out = np.zeros(len(self.t.hash), np.uint64)
        h = self.t.hash[1:]
        out[1:] = mix(self.names[d - 1][:-1] * _MULT + (h ^ (h >> np.uint64(31))))
        return out

    def candidates(self, d: int) -> np.ndarray:
        """Tokens at which a run of d + 1 can reach the minima."""
        n = self.counts[d - 1]
        ok = n >= self.known.min_entry
        ok[1:] &= n[:-1] >= self.known.min_context
        return np.flatnonzero(ok & (self.t.place >= d))

    def contexts(self, d: int) -> np.ndarray:
        """Tokens that follow a candidate context of length d."""
        ok = self.t.place >= d
        ok[1:] &= self.counts[d - 1][:-1] >= self.known.min_context
        return np.flatnonzero(ok)

    def prob(self, depth: int) -> np.ndarray:
        """Probability of each token under its longest retained context of at most that length."""
        p = self.known.root(self.counts[0])
        for d in range(1, depth + 1):
            if d not in self.tables.contexts:
                continue
            back = self.tables.contexts[d][1]
            rows = self.contexts(d)
            s = self.tables.context_index[d].find(self.names[d - 1][rows - 1])
            rows, s = rows[s >= 0], s[s >= 0]
            n = self.counts[d][rows]
            own = np.where(n > 0, n - self.known.discounts[d], 0.0) / self.counts[d - 1][rows - 1]
            p[rows] = own + back[s] * p[rows]
        return p


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weights, heads) if len(heads) else weights


def _dealt_keys(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Buckets of sorted hashes: ranges of equal width."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    which, first = np.unique(bucket, return_index=True)
    return [(k, slice(i, j)) for k, i, j in zip(which.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True)]


def _sender(known: Level, d: int, depth: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's counts of runs of d + 1 tokens (up to the depth) and its sums for contexts of d - 1 tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = _Tables(right)
        train = left["train"].to_numpy()
        block = left[BLOCK][0].as_py() if len(left) else 0
        keys, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if d >= 2:
            (context, total, _), (after, seen, own) = tables.runs[d - 2], tables.runs[d - 1]
            met = np.zeros(len(context), bool)
            told, prob = np.full(len(after), -1), np.ones(len(after))  # of each run that is told: its context, its probability by the shorter one
        for words in word_slices(left["text"]):
            t = _Tokens(words)
            r = _Runs(t, tables, known, d)
            if d <= depth:
                at = r.candidates(d) if d else np.arange(len(t.hash))
                name = r.next_names(d) if d else t.hash
                use = np.repeat(train[t.row : t.row + len(t.first) - 1], np.diff(t.first))
                k, n = _summed(name[at], use[at].astype(np.int64))
                keys.append(k)
                weights.append(n)
            if d >= 2:
                met[r.at[d - 2][r.contexts(d - 1) - 1]] = True
                at = np.flatnonzero(r.at[d - 1] >= 0)
                at = at[own[r.at[d - 1][at]]]
                told[r.at[d - 1][at]] = r.at[d - 2][at - 1]
                prob[r.at[d - 1][at]] = r.prob(d - 2)[at]
        k, n = _summed(np.concatenate(keys), np.concatenate(weights))
        rows = []
        for bucket, at in _dealt_keys(k, buckets):
            first, packed = _packed_keys(k[at])
            rows.append({"bucket": bucket, BLOCK: block, "context": False, "first": first, "keys": packed, "n": _packed(n[at])})
        if d >= 2:
            use = told >= 0
            told, seen, prob = told[use], seen[use], prob[use]
            add = lambda v: np.bincount(told, v, len(met))[met]
            sums = {"kinds": add(np.ones(len(told))), "seen": add(seen)}
            real = {"fit": add(seen * np.log(seen / prob)), "mass": add(prob)}
            context, total = context[met], total[met]
            for bucket, at in _dealt_keys(context, buckets):
                first, packed = _packed_keys(context[at])
                row = {"bucket": bucket, BLOCK: block, "context": True, "first": first, "keys": packed, "n": _packed(total[at])}
                rows.append(row | {x: _packed(v[at]) for x, v in sums.items()} | {x: v[at].tobytes() for x, v in real.items()})
        return _rows(rows, _SENT)

    return run


class _Grouped:
    """Entries of several rows, each sorted by hash, brought together by hash."""

    def __init__(self, rows: list[dict]):
        keys = [_unpacked_keys(r["first"], r["keys"]) for r in rows]
        self.rows, self.ends = rows, np.cumsum([len(k) for k in keys])
        self.keys = np.concatenate(keys)
        self.order = np.argsort(self.keys, kind="stable")
        sorted_keys = self.keys[self.order]
        self.heads = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        self.sizes = np.diff(np.append(self.heads, len(self.keys)))

    def column(self, name: str, real: bool = False) -> np.ndarray:
        parts = [np.frombuffer(r[name], np.float64) if real else _unpacked(r[name]).astype(np.int64) for r in self.rows]
        return np.concatenate(parts)[self.order]

    def sums(self, name: str, real: bool = False) -> np.ndarray:
        return np.add.reduceat(self.column(name, real), self.heads)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each hash for each of its entries."""
        out = np.empty(len(self.keys), values.dtype)
        out[self.order] = np.repeat(values, self.sizes)
        return out

    def parts(self, keep: np.ndarray) -> list[tuple[dict, np.ndarray]]:
        """Rows with the places of those of their entries that are kept."""
        at = np.flatnonzero(keep)
        cuts = np.split(at, np.searchsorted(at, self.ends[:-1]))
        return [(r, i) for r, i in zip(self.rows, cuts, strict=True) if len(i)]


def _bucket(known: Level, d: int, min_nats: float) -> Callable[[pa.Table], pa.Table]:
    """Adds up a bucket's runs of d + 1 tokens and tests its contexts of d - 1 tokens; each block gets its own of what is left."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out: list[dict] = []
        if runs := [r for r in rows if not r["context"]]:
            g = _Grouped(runs)
            total = g.sums("n")
            sums = (total == 1).sum(), (total == 2).sum(), (total > 0).sum(), total.sum()
            out += [{"level": d, "context": False, "rare": False, BLOCK: which, "first": int(v)} for which, v in zip(_SUMS, sums, strict=True)]
            own = np.zeros(len(g.keys), bool)
            own[g.order[g.heads]] = True
            n = g.spread(total)
            kept = [(False, n >= known.min_entry)] + ([] if d else [(True, (n > 0) & (n < known.min_entry))])
            for rare, keep in kept:
                for r, at in g.parts(keep):
                    first, packed = _packed_keys(g.keys[at])
                    out.append({"level": d, "context": False, "rare": rare, BLOCK: r[BLOCK], "first": first, "keys": packed, "n": _packed(n[at]), "own": np.packbits(own[at]).tobytes()})
        if met := [r for r in rows if r["context"]]:
            g = _Grouped(met)
            kinds, seen, fit, mass = g.sums("kinds"), g.sums("seen"), g.sums("fit", True), g.sums("mass", True)
            keep, back = _retained(kinds, seen, fit, mass, g.column("n")[g.heads], known.discounts[d - 1], min_nats)
            back = g.spread(back)
            for r, at in g.parts(g.spread(keep)):
                first, packed = _packed_keys(g.keys[at])
                out.append({"level": d - 1, "context": True, "rare": False, BLOCK: r[BLOCK], "first": first, "keys": packed, "back": back[at].tobytes()})
        return _rows(out, _TABLE)

    return run


def _cut(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and Spark drops the shuffle files of the job, which nothing reads again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _discount(once: int, twice: int) -> float:
    return min(once / (once + 2 * twice), 0.9) if once else 0.5


def _retained(kinds: np.ndarray, seen: np.ndarray, fit: np.ndarray, mass: np.ndarray, total: np.ndarray, discount: float, min_nats: float) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts pass the test, and the weight that each leaves to the shorter one."""
    other = total - seen
    rest = np.maximum(1 - mass, 1e-12)
    gain = fit - seen * np.log(total) + np.where(other > 0, other * np.log(np.maximum(other, 1) / (total * rest)), 0.0)
    df = np.maximum(kinds, 1)
    limit = df + 4 * np.sqrt(2 * df) + 8  # above the 0.9999 point of chi-squared
    back = np.maximum(1 - (seen - kinds * discount) / total, 1e-12)
    return (2 * gain > limit) & (gain / total > min_nats), back


def _scorer(known: Level, depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = _Tables(right)
        cols: list[list] = [[], [], [], []]
        for words in word_slices(left["text"]):
            t = _Tokens(words)
            r = _Runs(t, tables, known, depth + 1)
            begin = t.first[:-1]
            cols[0].append(np.diff(t.first))
            cols[1].append(np.add.reduceat((r.counts[0] > 0).astype(np.int64), begin))
            cols[2].append(np.add.reduceat(np.log10((r.counts[0] + 1) / (known.tokens + known.known + 1)), begin))
            cols[3].append(np.add.reduceat(np.log10(r.prob(depth)), begin))
        out = [np.concatenate(x) if x else np.zeros(0) for x in cols]
        return pa.table(
            {"id": left["id"], "n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64), "train_tokens": np.full(len(left), known.tokens, np.int64), "base_score": out[2], "score": out[3]}
        )

    return run


def fit_and_score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_context: int = MIN_CONTEXT,
    min_entry: int = MIN_ENTRY,
    min_nats: float = MIN_NATS,
    blocks: int | None = None,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The model learns from the rows for which ``train`` holds; rows of another
    corpus are scored by uniting them with the training rows.  ``min_entry``
    is at most ``min_context`` and at least 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = block_counts(rows, "text", blocks)
    buckets = blocks or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    x = dealt(rows, "id", "text", counts=counts)
    known = Level(min_context, min_entry)
    tables: list[DataFrame] = [docs.sparkSession.createDataFrame([], _TABLE)]
    for d in range(depth + 2):
        sent = _per_block(x, tables, False, _sender(known, d, depth, buckets), _SENT)
        found = _cut(sent.groupBy("bucket").applyInArrow(_bucket(known, d, min_nats), _TABLE), "runs")
        tables.append(found.where(F.col(BLOCK) >= 0))
        if d <= depth:
            sums = {r[0]: r[1] for r in found.where(F.col(BLOCK) < 0).groupBy(BLOCK).agg(F.sum("first")).collect()}
            once, twice = sums.get(_ONCE, 0), sums.get(_TWICE, 0)
            known = replace(known, discounts=(*known.discounts, _discount(once, twice)))
            if d == 0:
                known = replace(known, tokens=sums.get(_TOTAL, 0), known=sums.get(_KINDS, 0), unseen=max(1.0, once * (once - 1) / (2 * (twice + 1))))
    kind = x.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _per_block(x, tables, True, _scorer(known, depth), schema).withColumnRenamed("id", id_col)


def _per_block(x: DataFrame, tables: list[DataFrame], rare: bool, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block of documents with its share of the tables, with or without runs below the minimum."""
    table = tables[0]
    for t in tables[1:]:
        table = table.union(t)
    table = table if rare else table.where(~F.col("rare"))
    return x.groupBy(BLOCK).cogroup(table.groupBy(BLOCK)).applyInArrow(run, schema)

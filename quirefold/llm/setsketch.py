"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct ``shingle``-word runs (words lower-cased
A-Z; with fewer words the whole sequence; without words it is empty and links
with nothing).  Each element of the set throws points into ``REGISTERS``
registers at exponentially spaced times; a register keeps the logarithm of
its least time, truncated to 16 bits.  Registers of a union are the maxima of
the registers, so sketches merge, and two sets agree in a register about as
often as their Jaccard similarity.

1. Sets with equal digests form a class; only one row of it goes on.
2. ``BANDS`` bands of ``ROWS`` registers deal classes to buckets.  The member
   that shares buckets with the most others is a bucket's pivot (the original
   among its edited copies, as a rule) and meets every other member: a bucket
   of any size costs one pair a member.
3. Pairs are pruned by their sizes (exactly) and by the joint likelihood of
   both sketches given the known set sizes (5 standard deviations below the
   threshold), then confirmed on the full sets of the whole texts.
4. Buckets that still hold members of more than one component are taken up
   again: every member outside the bucket's largest component is held against
   all members, set against set, in tiles of bounded size, and only true
   links leave a tile.  So no pair of a bucket that could join two components
   goes untested, and no pairs are listed.

A pair at the threshold misses every bucket with probability 3e-6, less above.

Null ids never occur in links.  Rows that share an id are judged each by its
own text; repeated rows are returned once each.  Ties: the least id (of equal
ids, the least text hash) stands for a class and for a component.  Null and
empty texts link with nothing; an empty table gives no rows; other columns
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.arrays import Words, mix, runs_hash, word_slices
from quirefold.llm.components import connected_components
from quirefold.session import materialize, shuffle_partitions

REGISTERS, BANDS, ROWS = 160, 32, 5
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: Shingles of the members in a tile.
TILE = 500_000
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    h = words.hashes(lower=True)
    counts = words.counts
    first = words.first
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.repeat(first[:-1], per) + _within(per)
    length = np.repeat(np.where(counts >= size, size, counts), per)
    s = runs_hash(h, begin, begin + length)
    at = np.concatenate([[0], np.cumsum(per)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    doc = np.repeat(np.arange(len(per)), per)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(per)))])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sketch(elements: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """One row of registers for each set elements[first[i]:first[i+1]].

    An element's points come at the times of a Poisson process of rate m, each
    in a register drawn at random, so a register's least time over n elements
    is exponential with rate n.  Points later than a set's horizon cannot
    matter once all its registers are full; a set with an empty register is
    done again with a longer horizon.
    """
    n = np.diff(first)
    out = np.full((len(n), m), np.inf)
    todo, slack = np.flatnonzero(n), 5.0
    while len(todo):
        horizon = (math.log(m) + slack) / n[todo]
        for part in np.array_split(np.arange(len(todo)), max(1, len(todo) // 256)):
            _throw(elements, first, todo[part], horizon[part], m, out)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack *= 2
    low = np.where(np.isinf(out), RATE, np.maximum(out, 1e-300))
    k = np.floor(1.0 - np.log(low / RATE) / math.log(BASE))
    k[n == 0] = 0
    return np.clip(k, 0, LIMIT).astype(np.uint16)


def _throw(elements, first, sets, horizon, m, out):
    size = (first[sets + 1] - first[sets]).astype(np.int64)
    x = elements[np.repeat(first[sets], size) + _within(size)]
    who, until = np.repeat(sets, size), np.repeat(horizon, size)
    few = np.repeat(size < 48, size)
    flat = out.reshape(-1)
    # large sets: few points each, drawn one after the other
    s, w, t, u = x[~few], who[~few], np.zeros((~few).sum()), until[~few]
    hit_at, hit_t = [], []
    while len(s):
        s = mix(s + np.uint64(_GOLDEN))
        t = t - np.log1p(-_uniform(s)) / m
        on = t <= u
        s, w, t, u = s[on], w[on], t[on], u[on]
        hit_at.append(w * m + (mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64))
        hit_t.append(t)
    # small sets: many points each, one row an element
    s, w, u = x[few], who[few], until[few]
    if len(s):
        expect = m * u
        span = np.ceil(expect + 8 * np.sqrt(expect) + 12).astype(np.int64)
        for d in np.unique(span):
            rows = span == d
            seeds = np.empty((rows.sum(), d), np.uint64)
            cur = s[rows]
            for j in range(d):
                cur = mix(cur + np.uint64(_GOLDEN))
                seeds[:, j] = cur
            t = np.cumsum(-np.log1p(-_uniform(seeds)) / m, axis=1)
            r, c = np.nonzero(t <= u[rows][:, None])
            hit_at.append(w[rows][r] * m + (mix(seeds[r, c] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64))
            hit_t.append(t[r, c])
    if hit_at:
        at, t = np.concatenate(hit_at), np.concatenate(hit_t)
        order = np.lexsort((t, at))
        at, t = at[order], t[order]
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1]
        flat[at[head]] = np.minimum(flat[at[head]], t[head])


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimate of sketch rows, given both set sizes."""
    m = ka.shape[1]
    more, less = (ka > kb).sum(axis=1), (ka < kb).sum(axis=1)
    same = m - more - less
    u = na / (na + nb)
    v = nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p_more, p_less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    p_same = np.maximum(1 - p_more - p_less, 1e-12)
    like = (
        more[:, None] * np.log(np.maximum(p_more, 1e-12))
        + less[:, None] * np.log(np.maximum(p_less, 1e-12))
        + same[:, None] * np.log(p_same)
    )
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def band_keys(k: np.ndarray) -> np.ndarray:
    """One key a band for each sketch row."""
    g = k[:, : BANDS * ROWS].reshape(len(k), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], g.shape[:2]) * np.uint64(_GOLDEN)
    for i in range(ROWS):
        h = mix(h ^ (g[:, :, i] + np.uint64(i * 65536 + 1)))
    return h.view(np.int64)


def _registers(column: pa.Array, m: int = REGISTERS) -> np.ndarray:
    if not len(column):
        return np.zeros((0, m), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), m)


def _sketches(text_col: str, id_col: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(text_col)):
                s, first = shingle_sets(words, size)
                n = np.diff(first)
                k = sketch(s, first)
                d = [_sums(mix(s ^ np.uint64(seed)), first) for seed in (0x1234567, 0x89ABCDEF01)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).slice(words.row, len(n)),
                        batch.column("th").slice(words.row, len(n)),
                        pa.array(n.astype(np.int64)),
                        pa.array(d[0].view(np.int64)),
                        pa.array(d[1].view(np.int64)),
                        pa.array([r.tobytes() for r in k], pa.binary()),
                    ],
                    names=["id", "th", "n", "d1", "d2", "k"],
                )

    return run


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def _to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_registers(batch.column("k")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["key", "rep"])


def _to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rep): members of buckets of two or more."""
    last, open_rep, alone = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        carried = last is not None and key[0] == last
        head[0] = not carried
        heads = np.flatnonzero(head)
        group = np.cumsum(head) - 1  # -1: belongs to the carried bucket
        size = np.bincount(group + 1, minlength=len(heads) + 1)
        multi = size >= 2
        multi[0] = True
        keep = multi[group + 1]
        out_key, out_rep = key[keep], rep[keep]
        if carried and alone:
            out_key, out_rep = np.append(out_key, key[0]), np.append(out_rep, open_rep)
        if len(heads):
            open_rep, alone = int(rep[heads[-1]]), size[-1] == 1
        else:
            alone = False
        last = key[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_rep)], names=["key", "rep"])


def _likely(percent: int):
    least = max(0.0, percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float)
            ok = estimate(_registers(batch.column("ka")), _registers(batch.column("kb")), na, nb) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(size: int, percent: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for words in word_slices(column):
            s, first = shingle_sets(words, size)
            out += [s[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(sets(batch.column("ta")), sets(batch.column("tb")), strict=True):
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(x) + len(y) - common
                ok.append(union > 0 and 100 * common >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: bool = False
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents with 100 * |A n B| >= percent * |A u B| are linked;
    component_id is the least id reachable over links.  rows: also text_hash
    (xxhash64 of the text) and first, whether the row's id and text are those
    that stand for the component.
    """
    n = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    sk = materialize(source.mapInArrow(_sketches("text", "id", shingle), "id long, th long, n long, d1 long, d2 long, k binary"), "sketches")
    # identical sets: one class, whatever their number
    classes = sk.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "th")).alias("least"), F.first("k").alias("k"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    buckets = materialize(
        classes.select("rep", "k")
        .mapInArrow(_to_bands, "key long, rep long")
        .repartition(n, "key")
        .sortWithinPartitions("key", "rep")
        .mapInArrow(_to_buckets, "key long, rep long"),
        "buckets",
    )

    # whole texts move once, and only those of bucket members go on; the joins on
    # text are merge joins at every size, so that growth stays in proportion
    members = buckets.select("rep").distinct().join(classes.select("rep", "least.id", "least.th"), "rep")
    texts = materialize(source.join(members.hint("merge"), ["id", "th"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"))
        b = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
        fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return materialize(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(fit).mapInArrow(_likely(percent), "a long, b long"), "pairs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
        return materialize(pairs.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")

    links = confirmed(likely(_stars(buckets)))
    parts = connected_components(links, "a", "b")
    more = materialize(_open_links(buckets, parts, classes, texts, shingle, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = connected_components(links, "a", "b")
    nodes = parts.join(classes.select(F.col("rep").alias("node"), "least"), "node")
    roots = nodes.groupBy("component").agg(F.min("least").alias("root"))
    rooted = nodes.join(roots, "component").select(F.col("node").alias("rep"), "root")
    named = classes.join(rooted, "rep", "left").select("d1", "d2", "n", F.coalesce("root", "least").alias("root"))
    out = sk.drop("k").join(named, ["d1", "d2", "n"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("root.id", "id"))
    more_columns = []
    if rows:
        own = F.struct("id", "th")
        more_columns = [F.col("th").alias("text_hash"), F.coalesce(F.coalesce("root", own) == own, F.lit(True)).alias("first")]
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"),
        *more_columns,
    )


def _stars(buckets: DataFrame) -> DataFrame:
    """Each member with its bucket's pivot: the member that meets most others over all its buckets."""
    size = buckets.groupBy("key").agg(F.count("*").alias("size"))
    weight = buckets.join(size, "key").groupBy("rep").agg(F.sum("size").alias("weight"))
    order = F.struct("weight", -F.col("rep"))
    pivot = buckets.join(weight, "rep").groupBy("key").agg(F.max_by("rep", order).alias("pivot"))
    pairs = buckets.join(pivot, "key").where("rep <> pivot")
    return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _open_links(buckets, parts, classes, texts, shingle: int, percent: int) -> DataFrame:
    """Links between different components that meet in a bucket."""
    b = buckets.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    per = b.groupBy("key", "c").agg(F.count("*").alias("size"))
    big = per.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("big"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    live = materialize(b.join(big, "key").join(classes.select("rep", "n"), "rep"), "open")
    tiles = live.groupBy("key").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    dealt = live.join(tiles, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", (F.col("c") != F.col("big")).alias("out"))
    return dealt.join(texts.hint("merge"), "rep").groupBy("key", "i", "j").applyInArrow(_tile(shingle, percent), "a long, b long").distinct()


def _tile(shingle: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        parts, first = [], [np.zeros(1, np.int64)]
        for words in word_slices(table["text"]):
            s, f = shingle_sets(words, shingle)
            parts.append(s)
            first.append(f[1:] + first[-1][-1])
        first = np.concatenate(first)
        _, local = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.diff(first)
        rep, c, own = (table[x].to_numpy() for x in ("rep", "c", "own"))
        two = table["i"][0].as_py() != table["j"][0].as_py()
        mark = np.zeros(local.max() + 1, np.int32)
        a, b = [], []
        for x in np.flatnonzero(table["out"].to_numpy()):
            mine = local[first[x] : first[x + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[local], first[:-1])  # no set here is empty
            mark[mine] = 0
            hit = (100 * common >= percent * (n + n[x] - common)) & (c != c[x])
            if two:
                hit &= own != own[x]
            for y in np.flatnonzero(hit):
                a.append(min(rep[x], rep[y]))
                b.append(max(rep[x], rep[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run

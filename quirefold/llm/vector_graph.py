"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors form a class under a number of its own; its size goes on.
2. Pivots are k-means centres of a bounded sample (``SAMPLE`` vectors a
   pivot, ``MAX_PIVOTS`` at most).  A vector is stored in the shards of its
   ``STORED`` nearest pivots, so shards overlap; shards of more than ``SHARD``
   vectors, and their queries beyond ``QUERIES``, are split by hash, so no
   task holds an unbounded group.
3. Each shard builds a flat graph: every vector's nearest neighbours, pruned
   robustly (a neighbour goes if a nearer kept one is closer to it by the
   factor ``ALPHA``), ``DEGREE`` at most.
4. The adjacency lists of a vector from all its shards are united, reverse
   edges included, and sent back to its shards.
5. Every vector is a query in the shards of its ``VISITED`` nearest pivots:
   greedy search from the shard's medoid (and from its own node where it is
   stored), then range expansion over all nodes within the threshold until
   none is new.  Similarities are cosines in double precision, so every link
   is verified where it is found.  A pair that two shards could report counts
   in one of them.  Tasks return a count a query and one edge a node towards
   its least id there: linear, however many pairs a group has.
6. Blocks of vectors (``AUDIT``, then more, ``MOST`` in all) are searched
   exactly against all rows until linked vectors of ``GROUPS`` groups are
   among them.  Recall is taken by link, by vector and by group, without
   links to copies; if the least of them is below ``RECALL``, overlap and
   visits double and the graph is built again.  Where too few groups were
   met to decide, they double as well, and the narrower build is held
   against the wider one over all vectors.

Results: vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing; vectors link only within their length (each
length is a build of its own).  An empty table gives no rows.  Rows that repeat an id are vectors of their own.  A null id is returned as such
and names no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.components import connected_components
from quirefold.llm.voronoi_knn import lengths, matrix, usable
from quirefold.session import materialize

SAMPLE, MAX_PIVOTS, SHARD = 16, 4096, 2000
STORED, VISITED = 2, 4
CANDIDATES, DEGREE, ALPHA, BEAM, EXPAND = 48, 16, 1.2, 8, 16
AUDIT, RECALL = 64, 0.98
GROUPS, MOST = 32, 2048
#: Queries that search a shard's part in one task.
QUERIES = 20_000
PIECE = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; scaled by a power of two first, so that no square overflows or vanishes."""
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of unit vectors, started from the first k."""
    c = sample[:k].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def robust_prune(s: np.ndarray) -> np.ndarray:
    """Neighbours of each row of a similarity matrix, -1 where fewer are kept."""
    m = len(s)
    n = min(CANDIDATES, m - 1)
    if n <= 0:
        return np.full((m, 1), -1)
    t = s.copy()
    np.fill_diagonal(t, -np.inf)
    cand = np.argpartition(-t, n - 1, axis=1)[:, :n]
    rows = np.arange(m)
    near = t[rows[:, None], cand]
    far = np.sqrt(np.maximum(2 - 2 * near, 0))
    alive = np.ones_like(near, bool)
    out = np.full((m, DEGREE), -1)
    for r in range(DEGREE):
        best = np.where(alive, near, -np.inf).argmax(axis=1)
        ok = alive[rows, best]
        pick = cand[rows, best]
        out[ok, r] = pick[ok]
        between = np.sqrt(np.maximum(2 - 2 * s[pick[:, None], cand], 0))
        alive &= ALPHA * between > far
        alive[rows, best] = False
        if not alive.any():
            break
    return out


def search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, own: np.ndarray, medoid: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with similarity >= least that the graph search meets.

    adj: neighbours of each node, -1 for none; own: the query's node or -1.
    """
    hits_q, hits_x = [], []
    for a in range(0, len(q), PIECE):
        v, start = q[a : a + PIECE], own[a : a + PIECE]
        n, rows = len(v), np.arange(len(v))
        sim = np.full((n, len(x)), -np.inf)  # of the nodes met
        open_ = np.zeros((n, len(x)), bool)
        for entry in (np.full(n, medoid), start):
            r = rows[entry >= 0]
            e = entry[r]
            sim[r, e] = np.einsum("ij,ij->i", v[r], x[e])
            open_[r, e] = True
        beam = np.full((n, BEAM), -np.inf)  # best similarities so far, ascending
        first = np.sort(np.stack([sim[:, medoid], np.where(start >= 0, sim[rows, np.maximum(start, 0)], -np.inf)], axis=1), axis=1)
        k = min(2, BEAM)
        beam[:, -k:] = first[:, -k:]
        active = rows
        while len(active):
            w = np.where(open_[active], sim[active], -np.inf)
            at = w.argmax(axis=1)
            best = w[np.arange(len(active)), at]
            go = np.isfinite(best) & ((best >= least) | (best >= beam[active, 0]))
            if not go.any():
                break
            # the best open node of each query, or up to EXPAND of those within range
            near_q, near_x = np.nonzero(w >= least)
            within = np.arange(len(near_q)) - np.searchsorted(near_q, near_q)
            near_q, near_x = near_q[within < EXPAND], near_x[within < EXPAND]
            far = go & (best < least)
            from_q, from_x = np.concatenate([near_q, np.flatnonzero(far)]), np.concatenate([near_x, at[far]])
            open_[active[from_q], from_x] = False
            near = adj[from_x]
            r, c = np.nonzero(near >= 0)
            pair = np.unique(active[from_q[r]] * len(x) + near[r, c])
            qi, node = pair // len(x), pair % len(x)
            active = active[go]
            new = ~np.isfinite(sim[qi, node])
            qi, node = qi[new], node[new]
            if not len(qi):
                continue
            s = np.einsum("ij,ij->i", v[qi], x[node])
            sim[qi, node] = s
            open_[qi, node] = True
            # the beam keeps the BEAM best of each query
            col = np.arange(len(qi)) - np.searchsorted(qi, qi)
            wide = np.full((len(active), int(col.max()) + 1), -np.inf)
            wide[np.searchsorted(active, qi), col] = s
            both = np.concatenate([beam[active], wide], axis=1)
            both.sort(axis=1)
            beam[active] = both[:, -BEAM:]
        i, j = np.nonzero(sim >= least)
        hits_q.append(i + a)
        hits_x.append(j)
    if not hits_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hits_q), np.concatenate(hits_x)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component over edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(classes: DataFrame, pivots: np.ndarray, least: float, stored: int, visited: int) -> DataFrame:
    """(id, n, root): for each class and task, links counted there and an edge towards a smaller id."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    visited = min(visited, len(pivots))
    stored = min(stored, len(pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-(unit(matrix(batch.column("v"))) @ p.T), axis=1, kind="stable")[:, :visited].astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, visited, dtype=np.int32)), pa.array(order.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, near], names=["id", "v", "weight", "near"])

    placed = materialize(classes.mapInArrow(place, "id long, v array<double>, weight long, near array<int>"), "placed")
    data = placed.withColumn("shard", F.explode(F.slice("near", 1, stored)))
    parts = data.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("g"))
    data = data.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).drop("g")
    data = materialize(data, "shards")

    def build(table: pa.Table) -> pa.Table:
        x, ids = unit(matrix(table["v"])), table["id"].to_numpy()
        near = robust_prune(x @ x.T)
        a, c = np.nonzero(near >= 0)
        b = near[a, c]
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "to": np.concatenate([ids[b], ids[a]])})

    edges = data.groupBy("shard", "part").applyInArrow(build, "id long, to long")
    # a list holds the degree of each shard and its reverse edges there; shards are bounded, so lists are
    lists = edges.groupBy("id").agg(F.collect_set("to").alias("adj"))
    full = data.join(lists, "id", "left").select("shard", "part", "id", "v", "weight", "near", "adj")
    asked = placed.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("near").alias("qnear"), F.explode("near").alias("qshard"))
    tiles = asked.groupBy("qshard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("h"))
    full = full.join(tiles.withColumnRenamed("qshard", "shard"), "shard").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).drop("h")
    asked = (
        asked.join(parts.withColumnRenamed("shard", "qshard"), "qshard")
        .join(tiles, "qshard")
        .withColumns({"qtile": F.pmod(F.xxhash64("qid"), F.col("h")).cast("int"), "qpart": F.explode(F.sequence(F.lit(0), F.col("g") - 1))})
        .drop("g", "h")
    )

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ids = right["id"].to_numpy()
        order = np.argsort(ids)
        ids, right = ids[order], right.take(pa.array(order))
        x, weight = unit(matrix(right["v"])), right["weight"].to_numpy()
        lists = right["adj"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([0 if v is None else len(v) for v in lists.to_pylist()])
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        at = np.where(ids[at] == flat, at, -1)
        adj = np.full((len(ids), max(1, int(size.max(initial=0)))), -1)
        row = np.repeat(np.arange(len(ids)), size)
        adj[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = at
        qid = left["qid"].to_numpy()
        q = unit(matrix(left["qv"]))
        own = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
        own = np.where(ids[own] == qid, own, -1)
        medoid = int((x @ x.sum(axis=0)).argmax())
        i, j = search(x, adj, q, own, medoid, least)
        # the pair counts in the first of the stored vector's shards that the query visits
        shard = right["shard"][0].as_py()
        homes, visits = matrix(right["near"])[:, :stored].astype(int), matrix(left["qnear"]).astype(int)
        sees = (homes[j][:, :, None] == visits[i][:, None, :]).any(axis=2)
        count = homes[j, sees.argmax(axis=1)] == shard
        n = np.bincount(i[count], weights=weight[j[count]], minlength=len(qid)).astype(np.int64)
        nodes = np.unique(np.concatenate([qid, ids]))
        root = local_roots(len(nodes), np.searchsorted(nodes, qid[i]), np.searchsorted(nodes, ids[j]))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"id": np.concatenate([qid, nodes[moved]]), "n": np.concatenate([n, np.zeros(len(moved), np.int64)]), "root": np.concatenate([qid, nodes[root[moved]]])})

    return asked.groupBy("qshard", "qpart", "qtile").cogroup(full.groupBy("shard", "part", "tile")).applyInArrow(find, "id long, n long, root long")


def audit(classes: DataFrame, counts: DataFrame, least: float, size: int = AUDIT) -> float | None:
    """Recall of the counted links against an exact search over all rows: the least of those by link, vector and group.

    None: too few linked groups among ``MOST`` vectors to tell.
    """
    drawn = classes.withColumn("h", F.xxhash64("id")).orderBy("h").limit(MOST).join(counts, "id").toArrow().sort_by("h")
    if not len(drawn):
        return 1.0
    q, own, n = unit(matrix(drawn["v"])), drawn["weight"].to_numpy(), drawn["n"].to_numpy()
    true, low, done = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), 0
    while done < len(q):
        stop = min(len(q), max(size, 4 * done))
        true[done:stop], low[done:stop] = _exact(classes, q[done:stop], least)
        done = stop
        linked = np.flatnonzero(true[:done] > own[:done])
        # groups: drawn vectors that link, or share their least link
        a, b = np.nonzero(q[linked] @ q[linked].T >= least)
        _, first, back = np.unique(low[linked], return_index=True, return_inverse=True)
        rows = np.arange(len(linked))
        root = local_roots(len(linked), np.concatenate([a, rows]), np.concatenate([b, first[back]]))
        if len(np.unique(root)) >= GROUPS:
            break
    else:
        if len(q) == MOST:
            return None
    if not len(linked):
        return 1.0
    links = (true - own)[linked]
    share = np.maximum(np.minimum(n, true) - own, 0)[linked] / links
    size_of = np.bincount(root)[root]
    return min(np.average(share, weights=w) for w in (links, np.ones(len(links)), 1 / size_of))


def _exact(classes: DataFrame, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of ``q``: rows within the threshold, and the least id there."""
    shared = classes.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total, low = np.zeros(len(q), np.int64), np.full(len(q), np.iinfo(np.int64).max)
        for batch in batches:
            for part in (batch.slice(i, PIECE) for i in range(0, batch.num_rows, PIECE)):
                i, j = np.nonzero(q @ unit(matrix(part.column("v"))).T >= least)
                np.add.at(total, i, part.column("weight").to_numpy()[j])
                np.minimum.at(low, i, part.column("id").to_numpy()[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(total), pa.array(low)], names=["at", "true", "low"])

    found = classes.mapInArrow(run, "at long, true long, low long").groupBy("at").agg(F.sum("true").alias("true"), F.min("low").alias("low")).toArrow().sort_by("at")
    return found["true"].to_numpy(), found["low"].to_numpy()


def agreement(classes: DataFrame, narrow: DataFrame, wide: DataFrame) -> float:
    """Share of the wide build's links that the narrow one has: the least of those by link, vector and group."""
    both = classes.select("id", "weight").join(narrow.withColumnRenamed("n", "m"), "id").join(wide, "id")
    links = F.col("n") - F.col("weight")
    share = F.greatest(F.least("m", "n") - F.col("weight"), F.lit(0)) / links
    by = [links, F.lit(1.0), 1 / (links + 1)]  # a group's members have about as many links as it has members
    row = both.where(links > 0).agg(*[F.sum(share * w) / F.sum(w) for w in by]).first()
    return min((x for x in row if x is not None), default=1.0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: v.cast("double")).alias("v"))
    fine = usable(rows, "v").where(F.exists("v", lambda v: v != 0) & F.col("id").isNotNull())
    sizes = lengths(fine, "v")
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    named = reduce(DataFrame.unionByName, [_named(fine.where(F.size("v") == n) if len(sizes) > 1 else fine, least) for n in sizes])
    out = rows.join(named, rows["v"] == named["v"], "left").where("true")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.greatest(F.coalesce(F.col("n") - 1, F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        comp.alias("component_id"),
        F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"),
    )


def _named(fine: DataFrame, least: float) -> DataFrame:
    """(v, n, component) of each different vector, all of one length: links, its copies included, and the least id it reaches."""
    groups = fine.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    groups = materialize(groups.select(F.monotonically_increasing_id().alias("id"), "v", "weight", "least"), "vectors")
    classes = groups.select("id", "v", "weight")
    n = classes.count()
    k = min(MAX_PIVOTS, max(1, -(-n // (SHARD // 4))))
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE * k).select("v").toArrow()
    pivots = centres(unit(matrix(sample["v"])), min(k, len(sample)))
    stored, visited, narrow = STORED, VISITED, None
    while True:
        found = materialize(_links(classes, pivots, least, stored, visited), "links")
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        if visited >= len(pivots):
            break
        recall = audit(classes, counts, least)
        if recall is None and narrow is not None:
            recall = agreement(classes, narrow, counts)
        if recall is not None and recall >= RECALL:
            break
        narrow = counts
        stored, visited = 2 * stored, 2 * visited
    parts = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "a", "b")
    nodes = parts.withColumnRenamed("node", "id").join(groups.select("id", "least"), "id")
    rooted = nodes.join(nodes.groupBy("component").agg(F.min("least").alias("root")), "component").select("id", "root")
    return groups.join(counts, "id").join(rooted, "id", "left").select("v", F.col("n"), F.coalesce("root", "least").alias("component"))

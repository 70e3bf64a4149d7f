"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become whole numbers floor(scale * component), so scores are exact.
Pivots are data vectors (``PIVOTS`` at most, a fixed sample by hash); every
vector belongs to the cell of its nearest pivot.  A cell's summary is its
size, its pivot, its largest distance r to the pivot and the k smallest
distances.  For a query q and a vector x of a cell with pivot p,

    q.p - |q| * |x - p|  <=  q.x  <=  q.p + |q| * |x - p|,

so the k-th largest lower bound over all summaries is a bound on q's k-th
score, and x matters for q only if its upper bound reaches it.  Queries are
grouped by their cells into groups of bounded size; a vector is replicated to
a query group only if it matters for one of its queries, and each group's
vectors are dealt to blocks of bounded size.  Each (group, block) is solved
with one matrix product and passes on k candidates a query; these are merged
by score and id.

Where cells overlap as much as in unclustered data the bounds prune little,
and the join is the stated query set against all rows, in blocks.

Results: vectors that are null, empty, or hold a null or non-finite component
take no part; vectors of different lengths are no candidates for each other
(each length is a join of its own); products too large for double precision
are added up as whole numbers of any size, and one beyond a long raises; an
empty table gives no rows; ties go to the smaller id; a query has fewer than k rows only if there are fewer candidates;
rows that repeat an id are candidates each, but never for their own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import materialize, shuffle_partitions

PIVOTS = 64
#: Queries in a group and vectors in a block.
GROUP, BLOCK_ROWS = 4096, 32768
_SLACK = 1e-6
#: Rows that share a query's id, up to which cells are bounded; beyond, every row is compared.
OWN = 1000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls and of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null, not empty and finite throughout."""
    x = F.col(vec)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False)))


def lengths(vectors: DataFrame, vec: str) -> list[int]:
    """The different lengths of the vectors; a table of embeddings has one, or a few."""
    return sorted(r["n"] for r in vectors.select(F.size(vec).alias("n")).distinct().collect())


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """The same as Python's integers of any size."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def bounds(pivots: np.ndarray, nearest: list[np.ndarray], queries: np.ndarray, k: int) -> np.ndarray:
    """Lower bound of each query's k-th score; nearest: a cell's k smallest distances."""
    dots, norms = queries @ pivots.T, np.linalg.norm(queries, axis=1)
    if not k:
        return np.full(len(queries), -np.inf)
    low = np.concatenate([dots[:, [i]] - norms[:, None] * d[None, :] for i, d in enumerate(nearest)], axis=1)
    if low.shape[1] < k:
        return np.full(len(queries), -np.inf)
    return -np.partition(-low, k - 1, axis=1)[:, k - 1]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best other rows; ``is_query``: a condition on ``vectors``."""
    whole = F.transform(vec_col, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    data = usable(vectors, vec_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = lengths(data, "v")
    found = [_top_k(data.where(F.size("v") == n) if len(sizes) > 1 else data, id_col, k) for n in sizes or [0]]
    return reduce(DataFrame.unionByName, found)


def _top_k(data: DataFrame, id_col: str, k: int) -> DataFrame:
    """The same of vectors of one length."""
    spark = data.sparkSession
    sample = data.orderBy(F.xxhash64("v"), "id").limit(PIVOTS).select("v").toArrow()
    pivots = np.unique(matrix(sample["v"]), axis=0)
    if not len(pivots):
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    shared = spark.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                cell = (2 * x @ p.T - (p * p).sum(axis=1)).argmax(axis=1)
                r = np.linalg.norm(x - p[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r)], names=["id", "v", "q", "cell", "r"])

    placed = materialize(data.mapInArrow(cells, "id long, v array<double>, q boolean, cell int, r double"), "cells")
    # as many rows more than k as share a query's id, as none of them is a candidate for it
    own = placed.groupBy("id").agg(F.count("*").alias("n"), F.max("q").alias("q")).where("q").agg(F.max("n")).first()[0] or 1
    norm = F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)
    most = placed.agg(F.max(norm)).first()[0]  # no product, nor a part of its sum, is larger
    exact = most < 2.0**53
    bounded = own <= OWN and exact
    depth = k + own if bounded else 0
    first = placed.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("r"))).where(F.col("at") <= depth)
    nearest: list[list[float]] = [[] for _ in pivots]
    for row in first.select("cell", "r").collect():  # at most (k + OWN) * PIVOTS rows
        nearest[row["cell"]].append(row["r"])
    summary = spark.sparkContext.broadcast([np.array(sorted(x)) for x in nearest])

    queries = placed.where("q")
    sizes = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    splits, total = np.ones(len(pivots), np.int64), 0
    for c, n in sizes.items():
        splits[c] = -(-n // GROUP)
        total += int(splits[c])
    # small neighbouring cells share a group
    order = sorted(sizes, key=lambda c: tuple(pivots[c]))
    group_of, g, room = {}, -1, 0
    for c in order:
        if splits[c] > 1 or sizes[c] > room:
            g, room = g + 1, GROUP
        group_of[c] = g
        if splits[c] > 1:
            g, room = g + int(splits[c]) - 1, 0
        else:
            room -= sizes[c]
    if not group_of:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    table = F.create_map(*[F.lit(x) for c in group_of for x in (c, group_of[c])])
    parts = F.create_map(*[F.lit(x) for c in group_of for x in (c, int(splits[c]))])
    grouped = queries.withColumn("g", F.element_at(table, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell"))).cast("int"))

    # per group: the cells' summaries against its queries give, for each cell, the distance from which rows matter
    def reach(batch_table: pa.Table) -> pa.Table:
        p, near = shared.value, summary.value
        q = matrix(batch_table["v"])
        floor_ = bounds(p, near, q, depth) if bounded else np.full(len(q), -np.inf)
        norms = np.linalg.norm(q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = (floor_[:, None] - q @ p.T) / norms[:, None]
        need = np.where(norms[:, None] > 0, need, -np.inf).min(axis=0) - _SLACK * (1 + np.abs(p).max())
        g = batch_table["g"][0].as_py()
        return pa.table({"g": np.full(len(p), g, np.int32), "cell": np.arange(len(p), dtype=np.int32), "least": need})

    needs = grouped.groupBy("g").applyInArrow(reach, "g int, cell int, least double")
    n_blocks = max(1, -(-placed.count() // BLOCK_ROWS))
    rows = placed.select("id", "v", "cell", "r").join(needs, "cell").where("r >= least").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    each = grouped.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("g").alias("qg")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumnRenamed("b", "qb")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [np.zeros(0, np.int64)], "id": [np.zeros(0, np.int64)], "score": [np.zeros(0, np.int64)]}
        if len(left) and len(right):
            q, x, qid, xid = matrix(left["qv"]), matrix(right["v"]), left["qid"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(xid, kind="stable")
            x, xid = x[order], xid[order]
            if not exact:  # whole numbers that double precision cannot add up
                q, x = whole_numbers(q), whole_numbers(x)
            for a in range(0, len(q), 64):
                if not exact:
                    for i, v in enumerate(q[a : a + 64]):
                        best = sorted((-int(p), int(t)) for p, t in zip(x @ v, xid, strict=True) if t != qid[a + i])[:k]
                        out["query_id"].append(np.full(len(best), qid[a + i]))
                        out["id"].append(np.array([t for _, t in best], np.int64))
                        out["score"].append(np.array([-p for p, _ in best], np.int64))  # raises beyond a long
                    continue
                s = q[a : a + 64] @ x.T
                s[qid[a : a + 64][:, None] == xid[None, :]] = -np.inf
                m = min(k, s.shape[1])
                edge = -np.partition(-s, m - 1, axis=1)[:, [m - 1]]
                for i in range(len(s)):
                    hit = np.flatnonzero((s[i] >= edge[i]) & np.isfinite(s[i]))
                    hit = hit[np.lexsort((xid[hit], -s[i][hit]))][:k]
                    out["query_id"].append(np.full(len(hit), qid[a + i]))
                    out["id"].append(xid[hit])
                    out["score"].append(s[i][hit].astype(np.int64))
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    found = each.groupBy("qg", "qb").cogroup(rows.groupBy("g", "b")).applyInArrow(solve, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

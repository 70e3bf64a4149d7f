"""op3 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import voronoi_knn
from quirefold.llm.voronoi_knn import top_k

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, is_query, k):
    fine = [(i, np.floor(np.array(v, np.float32).astype(float) * 256)) for i, v, _ in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if is_query(q):
            best = sorted((-int(v @ w), i) for i, w in fine if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(voronoi_knn, "PIVOTS", 8)
    monkeypatch.setattr(voronoi_knn, "GROUP", 7)
    monkeypatch.setattr(voronoi_knn, "BLOCK_ROWS", 40)
    rnd = random.Random(4)
    centres = [[rnd.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(centres)], 1) for i in range(200)]
    rows += [(300 + i, list(rows[0][1]), None) for i in range(12)]
    rows += [(400, None, 1), (402, [], 1), (404, [1.0, None, 2.0, 0.0], 1), (406, [float("nan"), 0.0, 0.0, 0.0], 1), (408, [float("inf"), 0.0, 0.0, 0.0], 1), (410, [1.0], 1), (412, [0.0] * 4, 1), (None, [1.0] * 4, 1)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 4 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 4 == 0, 5)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0, 0.0], 1)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536)]
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0

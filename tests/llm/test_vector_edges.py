"""Huge, tiny and mixed vectors through the vector operators, against exact arithmetic."""

import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import vector_graph, voronoi_knn


def test_links_of_huge_tiny_and_mixed_lengths(spark):
    rows = [
        (1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1.7e308, -1.7e308]), (6, [2.0, -2.1]),
        (7, [1.0, 1.0, 0.0]), (8, [2.0, 2.0, 0.1]), (9, [0.0, 0.0, 5.0]), (10, [3.0]), (11, [-3.0]), (12, []), (13, None), (14, [0.0, 0.0]), (15, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (17, [1.0, None]), (18, [1e-300]),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (1, 5, True), 6: (1, 5, False), 7: (1, 7, True), 8: (1, 7, False), 10: (1, 10, True), 18: (1, 10, False)}
    assert got == {i: want.get(i, (0, i, True)) for i, _ in rows}


def test_unit_rows():
    x = np.array([[1e200, 1e200], [1e-320, 0.0], [3.0, 4.0]])
    assert np.allclose(np.linalg.norm(vector_graph.unit(x), axis=1), 1) and vector_graph.unit(x)[2].tolist() == [0.6, 0.8]
    assert vector_graph.unit(np.zeros((0, 0))).shape == (0, 0)


def test_top_k_of_large_products_and_mixed_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * (1e6 + rng.random()) for _ in range(5)]) for i in range(40)] + [(i, [rng.random() for _ in range(3)]) for i in range(50, 70)] + [(80, []), (81, None), (82, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in voronoi_knn.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    whole = {i: [int(Fraction(x * 256) // 1) for x in v] for i, v in rows if v}
    want = {}
    for q in (i for i in whole if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert got == want and max(abs(s) for _, s in got.values()) > 2**53


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert voronoi_knn.top_k(none, F.lit(True)).count() == 0 and vector_graph.near_duplicates(none).count() == 0

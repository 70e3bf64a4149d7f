"""op9 against brute force."""

import random

import numpy as np

from quirefold.llm import vector_graph
from quirefold.llm.vector_graph import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, n_links int"


def brute(rows, least=0.9):
    fine = {}
    for n, (i, v, _) in enumerate(rows):
        if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            fine[n] = x / np.linalg.norm(x)
    keys = sorted(fine)
    links = {n: [] for n in range(len(rows))}
    if keys:
        s = np.stack([fine[k] for k in keys])
        for a, b in zip(*np.nonzero(s @ s.T >= least)):
            if a != b:
                links[keys[a]].append(keys[b])
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min(rows[m][0] for m in seen)
        out.append((i, len(links[n]), c, i == c))
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 80)
    monkeypatch.setattr(vector_graph, "QUERIES", 50)
    rnd = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = rnd.normal(size=16)
        for _ in range(int(rnd.integers(1, 12)) if g else 150):
            rows.append([len(rows), (base + rnd.normal(size=16) * rnd.choice([0.02, 0.15, 0.3])).tolist(), 1])
    rows += [[1000, rows[3][1], 1], [1001, rows[3][1], None], [1002, [2 * x for x in rows[5][1]], 1], [1003, None, 1], [1004, [0.0] * 16, 1], [1005, [float("nan")] * 16, 1], [1006, [None] * 16, 1], [1007, [1.0], 1], [1008, [], 1]]
    want = brute(rows)
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(got) == len(want)
    true, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert found <= true and found >= 0.98 * true
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.95


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(3, None, 1), (None, None, 1)], SCHEMA)).orderBy("vec_id").collect()] == [(None, 0, None, True), (3, 0, 3, True)]


def classes_of(spark, groups, seed=2):
    """(classes, sizes): groups of near vectors, and 600 vectors without links."""
    rnd, rows, sizes = np.random.default_rng(seed), [], {}
    for size in [*groups, *[1] * 600]:
        base = rnd.normal(size=64)
        for _ in range(size):
            sizes[len(rows)] = size
            rows.append((len(rows), (base + rnd.normal(size=64) * 0.02).tolist(), 1))
    return spark.createDataFrame(rows, "id long, v array<double>, weight long"), sizes


def counted(spark, sizes, found):
    return spark.createDataFrame([(i, n if found(n) else 1) for i, n in sizes.items()], "id long, n long")


def test_audit_sees_rare_and_small_groups(spark):
    classes, sizes = classes_of(spark, [2] * 8)
    assert vector_graph.audit(classes, counted(spark, sizes, lambda n: True), 0.9) == 1
    assert vector_graph.audit(classes, counted(spark, sizes, lambda n: False), 0.9) == 0
    classes, sizes = classes_of(spark, [400, *[2] * 60])
    assert vector_graph.audit(classes, counted(spark, sizes, lambda n: True), 0.9) == 1
    assert vector_graph.audit(classes, counted(spark, sizes, lambda n: n > 2), 0.9) < 0.5


def test_widens_when_too_few_groups_decide(spark, monkeypatch):
    classes, sizes = classes_of(spark, [30, *[2] * 4])
    monkeypatch.setattr(vector_graph, "MOST", 64)
    assert vector_graph.audit(classes, counted(spark, sizes, lambda n: True), 0.9) is None
    full, part = counted(spark, sizes, lambda n: True), counted(spark, sizes, lambda n: n > 2)
    assert vector_graph.agreement(classes, full, full) == 1 and vector_graph.agreement(classes, part, full) < 0.9
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    built, links = [], vector_graph._links
    monkeypatch.setattr(vector_graph, "_links", lambda *a: built.append(a[3:]) or links(*a))
    got = near_duplicates(classes.select(classes.id.alias("vec_id"), classes.v.alias("embedding"))).collect()
    assert built[:2] == [(2, 4), (4, 8)] and {r.vec_id: r.n_links + 1 for r in got} == sizes


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]

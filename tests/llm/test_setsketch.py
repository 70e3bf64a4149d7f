"""op5 against all pairs."""

import random

import numpy as np

from quirefold.llm.setsketch import estimate, near_duplicates, sketch


def shingles(text, k):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = t.encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(docs, k, percent):
    sets = {d[0]: shingles(d[1], k) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                c = len(sets[x] & sets[y])
                if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 12, 40, 120, 400]))]
        docs.append(base)
        for _ in range(rnd.randint(0, 5)):
            c = list(base)
            for _ in range(rnd.randint(0, max(1, len(c) // 25))):
                c[rnd.randrange(len(c))] = rnd.choice(vocab)
            docs.append(c)
    out = [(i, " ".join(w), "src") for i, w in enumerate(docs)]
    return [*out, (900, None, None), (901, "", "x"), (902, "w1", "x"), (903, "W1", None), (904, "w1 w2", None)]


def test_matches_all_pairs(spark):
    for seed, k in ((1, 2), (2, 5)):
        docs = corpus(seed)
        got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, component_id string"), shingle=k).collect()
        assert sorted(tuple(r) for r in got) == brute(docs, k, 80)


def test_repeated_rows_and_empty_table(spark):
    docs = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2600]
    k = sketch(np.concatenate([a, b, x[:2600]]), np.array([0, 2000, 4100, 6700]))
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    j = estimate(k[:1], k[1:2], np.array([2000.0]), np.array([2100.0]))[0]
    assert abs(j - 1500 / 2600) < 0.15


def test_large_group_with_outliers(spark, monkeypatch):
    """Edited copies of one text, some linked only to each other, with tiny tiles."""
    import quirefold.llm.setsketch as module

    monkeypatch.setattr(module, "TILE", 3000)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(150):
        c = list(base)
        for _ in range(rnd.randint(0, 14)):
            c[rnd.randrange(100)] = f"x{rnd.randint(0, 400)}"
        docs.append((i, " ".join(c)))
        if rnd.random() < 0.2:
            c[rnd.randrange(100)] = "y"
            docs.append((1000 + i, " ".join(c)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, 2, 80)


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, rows=True).collect()
    assert sorted((r.doc_id, r.component_id, r.kept, r.first) for r in got) == [(1, 1, True, True), (1, 1, True, True), (2, 1, False, False), (3, 1, False, False)]
    rows = [(5, a), (5, b), (2, a + " z"), (7, b + " z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 5), (7, 5)]

"""The filter audit against a run of every order over the documents in Python."""

import re
from itertools import permutations

import pytest

from quirefold.llm.filter_audit import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, kept string, A string, good int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        mine = [x for x in labels if x[0] == d and d is not None]
        rows.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = here
            for k, f in enumerate(order):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                total[f] += len(gone)
                sole = sum(r[1][f] and sum(r[1].values()) == 1 for r in here)
                out[part, order, k + 1] = [len(left), len(gone), sum(r[1][f] for r in here) - len(gone), sole, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(total[f])
    return out


def check(spark, docs, labels):
    got = audit(spark.createDataFrame([(*d, "old", "old", 7) for d in docs], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert want[r.part, r.filter_order, r.step] == [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley], r


def text(i):
    """Bits of i choose what the text fails."""
    words = ["w" if i & 2 else f"w{k}é" for k in range(120 if i & 1 else 260)]
    return " ".join((["$x"] if i & 8 else []) + (["ABCDEFGHIJ" * 4] if i & 4 else []) + words) + ("\t\n" if i % 3 else "")


def test_every_combination(spark):
    docs = [(i, text(i % 16), ["a", "b", None][i % 3]) for i in range(60)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (8, None, 1)]
    check(spark, docs, labels)


def test_edges(spark):
    docs = [
        (1, None, None), (2, "", "a"), (3, None, "a"), (5, "same words", "a"), (5, "same words", "a"), (5, "other words", "a"), (4, "same words", "b"),
        (None, "same words", "b"), (None, "same words", "b"), (None, "lone", None), (9, "long word " * 300_000, "b"), (10, "x" * 500_000, "b"),
    ]
    check(spark, docs, [(1, 1, 0), (5, 0, 1), (None, 1, 1)])


def test_empty(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    check(spark, [(1, "a b", "p")], [])


@pytest.mark.parametrize("hot", [3000])
def test_one_hot_text_and_part(spark, hot):
    docs = [(i, text(i % 5) if i % 3 else "copy of one text", "hot" if i % 4 else f"p{i % 7}") for i in range(hot)]
    check(spark, docs, [(i, 1, 1) for i in range(0, hot, 3)])

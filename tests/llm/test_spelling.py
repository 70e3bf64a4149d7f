"""Spelling variants against all pairs of words in Python, and the automaton against its word list."""

import random
import re
import zlib
from collections import Counter

import pytest

from quirefold.llm import spelling
from quirefold.llm.spelling import Automaton, variants

SCHEMA = "doc_id long, text string, word string, n int, half string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, {}
    for w, n in counts.items():
        other = [v for v in counts if near(w, v)]
        best = min(other, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (n, len(other))
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], counts[form[w]] if form[w] else None)
    return out


def check(spark, rows):
    got = variants(spark.createDataFrame([(*r, "old", 1, "x") for r in rows], SCHEMA)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(rows)
    assert len(got) == len({r.word for r in got})
    return got


def corpus(seed, letters, sizes, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(n)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.randrange(2) :] for w in words for i in (rng.randrange(len(w)), rng.randrange(len(w)))]
    weights = [rng.choice((1, 1, 6, 30, 160)) for _ in words]
    return [(d, " ".join(rng.choices(words, weights, k=400))) for d in range(60)]


def test_random_words(spark):
    got = check(spark, corpus(1, "abÀÿé", (6, 7, 8, 11), 150))
    assert any(r.form for r in got) and any(r.root != (r.form or r.word) for r in got)


def test_large_blocks(spark, monkeypatch):
    rows = corpus(2, "ab", (6, 7, 8, 9), 60)
    monkeypatch.setattr(spelling, "BOUND", 3)
    check(spark, rows)


def test_edges(spark):
    long = "aB" * 150_000
    rows = [(1, None), (2, ""), (3, "Straße STRASSE straße " * 30), (3, "Straße STRASSE straße " * 30), (None, "strasze " * 6 + "strassen × ÷÷÷÷÷÷÷ " * 5), (4, f"{long} " * 5 + f"{long}c " * 30), (5, "aaaaaa " * 9 + "aaaaaaa " * 60 + "aaaaaaaa " * 400), (6, "12345 " * 50), (7, "abcdef-abcdeg " * 5)]
    got = check(spark, rows)
    by = {r.word: r for r in got}
    assert by["aaaaaa"].root == "aaaaaaaa" and by["aaaaaa"].form == "aaaaaaa"


def test_empty(spark):
    check(spark, [(1, "too few words")])
    assert variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "abcdefghijkl mno pqrstuvw, xyz" * 5
    assert "".join(spelling._pieces(text)) == text
    assert [w for p in spelling._pieces(text) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in range(400)})
    a = Automaton(words)
    assert [a._walk(a.root, 0, w, 0) for w in words] == list(range(len(words)))
    assert a._walk(a.root, 0, "zz", 0) is None
    # minimal: no two states accept the same endings
    ends = {}
    for s in range(len(a.states)):
        accepts, moves = a.states[s]
        ends[s] = frozenset([""] * accepts) | {c + e for c, (t, _) in moves.items() for e in ends[t]}
    assert len(set(ends.values())) == len(ends)
    for w in rng.sample(words, 60):
        k = len(w) // 2
        assert {words[i] for i in a.near(w, k)} == {v for v in words if near(v, w) and v.startswith(w[:k])}

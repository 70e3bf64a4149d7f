"""op1: every score equals a plain suffix tree's, which sums to one and beats the base on held-out texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm.suffix_tree_lm import DEPTH, MIN_CONTEXT, MIN_ENTRY, MIN_NATS, _packed, _packed_keys, _unpacked, _unpacked_keys, fit_and_score

LOW = {"min_context": 40, "min_entry": 6, "min_nats": 0.01}


def corpus(seed, n=400):
    rnd = random.Random(seed)
    after = {w: [rnd.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    out = []
    for _ in range(n):
        w, words = rnd.choice("abcdefghij"), []
        for _ in range(rnd.randint(0, 40)):
            words.append(w.upper() if rnd.random() < 0.1 else w)
            w = rnd.choice(after[w]) if w in after and rnd.random() < 0.8 else rnd.choice("abcdefghijklmnop")
        if rnd.random() < 0.2:
            words.append(f"rare{rnd.randint(0, 60)}")
        out.append(" ".join(words))
    return out


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*(w.decode() for w in low.encode().split()), None]


class Plain:
    """The model of the docstring with dictionaries."""

    def __init__(self, texts, depth=DEPTH, min_context=MIN_CONTEXT, min_entry=MIN_ENTRY, min_nats=MIN_NATS):
        self.depth = depth
        runs = [Counter() for _ in range(depth + 1)]
        for x in texts:
            ts = tokens(x)
            for d in range(depth + 1):
                runs[d].update(tuple(ts[i : i + d + 1]) for i in range(len(ts) - d))
        self.runs, self.n, self.v = runs, sum(runs[0].values()), len(runs[0])
        once, twice = (sum(n == k for n in runs[0].values()) for k in (1, 2))
        self.unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)))
        self.discounts = [self.discount(runs[0].values())]
        self.own, self.back = {}, {}
        for d in range(1, depth + 1):
            open_ = {r: n for r, n in runs[d].items() if runs[d - 1][r[:-1]] >= min_context and runs[d - 1][r[1:]] >= min_entry}
            disc = self.discount(open_.values())
            contexts = {c: n for c, n in runs[d - 1].items() if n >= min_context and c[-1] is not None}
            kept = {}
            for c, total in contexts.items():
                after = {r[-1]: n for r, n in open_.items() if r[:-1] == c and n >= min_entry}
                p = {w: self.prob((*c[1:], w), d - 1) for w in after}
                rest, mass = total - sum(after.values()), max(1 - sum(p.values()), 1e-12)
                gain = sum(n * math.log(n / total / p[w]) for w, n in after.items()) + (rest * math.log(rest / total / mass) if rest else 0)
                df = max(len(after), 1)
                if 2 * gain > df + 4 * math.sqrt(2 * df) + 8 and gain / total > min_nats:
                    kept[c] = ({w: (n - disc) / total for w, n in after.items()}, max(1 - (sum(after.values()) - len(after) * disc) / total, 1e-12))
            for c, (own, back) in kept.items():
                self.own[c], self.back[c] = own, back

    @staticmethod
    def discount(counts):
        one, two = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return min(one / (one + 2 * two), 0.9) if one else 0.5

    def prob(self, run, depth):
        n = self.runs[0][run[-1:]]
        p = (n - self.discounts[0]) / self.n if n else self.discounts[0] * self.v / self.n / self.unseen
        for d in range(1, min(depth, len(run) - 1) + 1):
            c = run[-d - 1 : -1]
            if c in self.back:
                p = self.own[c].get(run[-1], 0.0) + self.back[c] * p
        return p

    def score(self, text):
        ts = tokens(text)
        return sum(math.log10(self.prob(tuple(ts[max(0, i - self.depth) : i + 1]), self.depth)) for i in range(len(ts)))


@pytest.mark.parametrize("minima", [LOW, {}], ids=["high minima", "as registered"])
def test_equals_a_plain_tree(spark, minima):
    train = corpus(1, 900)
    test = [*corpus(1, 1000)[900:], None, "", "A b unseen É"]
    model = Plain(train, **minima)
    assert {len(c) for c in model.back} >= {1, 2}
    rows = [(i, x, 1, True) for i, x in enumerate(train)] + [(900 + i, x, 2, False) for i, x in enumerate(test)] + [(900, test[0], 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, fit boolean")
    got = fit_and_score(docs, F.col("fit"), blocks=5, **minima).collect()
    assert len(got) == len(rows)
    texts, c, total = {r[0]: r[1] for r in rows}, model.runs[0], model.n
    for r in got:
        ts = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[(x,)] > 0 for x in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[(x,)] + 1) / (total + len(c) + 1)) for x in ts))
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9)
    held = [r for r in got if r.doc_id >= 900]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_sums_to_one():
    model = Plain(corpus(2, 900), **LOW)
    known = [r[0] for r in model.runs[0]]
    for history in ("a b c", "b", "zz q", "f g h a"):
        before = tuple(tokens(history)[:-1])
        assert sum(model.prob((*before, w), 3) for w in known) + model.unseen * model.prob((*before, "never seen"), 3) == pytest.approx(1, abs=1e-9)


def test_model_grows_with_the_corpus():
    few, many = Plain(corpus(3, 300), **LOW), Plain(corpus(3, 1500), **LOW)
    assert len(many.back) > len(few.back)


def test_packed_numbers():
    rnd = np.random.default_rng(5)
    for values in ([0], [255, 256], [2**64 - 1, 0, 7], rnd.integers(0, 2**63, 1000).tolist()):
        v = np.array(values, np.uint64)
        assert _unpacked(_packed(v)).tolist() == values
        assert _unpacked_keys(*_packed_keys(np.sort(v))).tolist() == sorted(values)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fit_and_score(none, F.lit(True)).count() == 0
    rows = fit_and_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).collect()
    assert (rows[0].n_tokens, rows[0].n_known, rows[0].train_tokens, rows[0].score) == (3, 0, 0, 0.0)

"""op7: proper distributions, held-out accuracy, defined edge cases."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm.langid import KneserNey, build, grams, identify, learn

SOUNDS = {"aa": ["tion", "er", "th", "ou", "the"], "bb": ["ung", "sch", "ei", "ö", "der"], "cc": ["eau", "é", "ou", "que", "ment"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_probabilities_sum_to_one():
    rnd = random.Random(1)
    counts = grams(Counter(text(rnd, "aa", 300).split()))
    letters = sorted({c for g in counts for c in g})
    m = KneserNey(counts, len(letters))
    for context in ["", " ", "t", " t", " th", "tion", "zzzz", "xer"]:
        assert abs(sum(m.prob(context + c) for c in letters) - 1) < 1e-9


def test_arrays_agree_with_recursion():
    rnd = random.Random(2)
    docs = {lang: [Counter(text(rnd, lang, 80).split()) for _ in range(10)] for lang in SOUNDS}
    model = build(docs)
    fit = {lang: grams(sum(d[:8], Counter())) for lang, d in docs.items()}
    alphabet = len({c for g in fit.values() for x in g for c in x}) + 1
    words = ["tion", "schei", "eauou", "thth", "ung", "a"]
    logs, chars = model.words(words)
    assert chars.tolist() == [len(w) + 1 for w in words]
    for j, lang in enumerate(model.langs):
        m = KneserNey(fit[lang], alphabet)
        for i, w in enumerate(words):
            s = f" {w} "
            want = sum(np.log2(m.prob(s[max(0, k - 4) : k + 1])) for k in range(1, len(s)))
            assert abs(logs[i, j] - want) < 1e-6


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    rows = [(i, text(rnd, lang, rnd.randint(2, 60)), lang, "x") for i, lang in enumerate(rnd.choice(list(SOUNDS)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = learn(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in identify(docs.where("doc_id % 3 = 1"), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if i % 3 == 1]) > 0.97
    assert not any(r.rejected for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, None), (2, "", "aa"), (3, "123 | --", "aa"), (4, "ღმერთი " * 400, None), (1, "the tion", None)], "doc_id long, text string, lang string")
    out = [(r.doc_id, r.lang_pred, r.rejected) for r in identify(odd, model).collect()]
    assert sorted(out)[:2] == [(1, "aa", False), (1, "und", True)]
    assert {x[0]: x[1:] for x in out if x[0] in (2, 3)} == {2: ("und", True), 3: ("und", True)}
    assert {x[0]: x[2] for x in out}[4]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(docs, learn(docs)).collect()] == ["und"]
    empty = docs.where("doc_id > 1")
    assert identify(empty, learn(empty)).count() == 0


def test_copies_count_once(spark):
    rnd = random.Random(4)
    rows = [(text(rnd, lang, 60), lang) for lang in SOUNDS for _ in range(40)]
    plain = spark.createDataFrame(rows, "text string, lang string")
    least = plain.groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    copied = plain.unionByName(least.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    a, b = learn(plain, per_lang=30), learn(copied, per_lang=30)
    assert [len(k) for k in a.gram_keys] == [len(k) for k in b.gram_keys]
    for name in ("mean", "between", "within", "limit"):
        assert np.allclose(getattr(a, name), getattr(b, name))


def test_hold_out_is_unseen_and_one_outlier_does_not_open_the_gate():
    rnd = random.Random(5)
    docs = {lang: [Counter(text(rnd, lang, 80).split()) for _ in range(100)] for lang in SOUNDS}
    clean = build(docs).limit
    spoiled = {**docs, "aa": [*docs["aa"][:-1], Counter({"ღმერთიაქვს": 400, "წყალიარის": 300})]}
    assert build(spoiled).limit[0] <= 2 * clean[0]
    two = build({lang: d[:2] for lang, d in docs.items()})
    assert two.gram_keys[5].tolist() == build({lang: d[:1] for lang, d in docs.items()}).gram_keys[5].tolist()
    assert not np.isfinite(build({"aa": docs["aa"][:1]}).limit).any()

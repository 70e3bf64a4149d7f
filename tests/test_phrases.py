"""Phrase matches against a scan of every text, and the dictionary operators on many terms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quirefold.operators import lexicon, phrases
from quirefold.plans import registry


def brute(texts, terms):
    known = {tuple(re.findall(r"[^\W_]+", t.lower())) for t in terms if t} - {()}
    out = []
    for i, text in texts:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        out += [(i, s, len(k), " ".join(k)) for k in known for s in range(len(w)) if tuple(w[s : s + len(k)]) == k]
    return sorted(out, key=str)


def test_hits_and_spans(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["a", "B", "c", "é", "12"], k=rng.randrange(40))) + rng.choice([".", "", "  \n"])) for i in range(60)] + [(98, None), (99, ""), (7, "a b c"), (105, "a " * 50_000)]
    terms = ["a b", "b", "C-é", "a b c a", "12", "", None, "a  b", "x y", "a a a"]
    t = spark.createDataFrame([(x, "old") for x in terms], "term string, start string")
    d = spark.createDataFrame([(*x, 1) for x in texts], "id int, text string, length int")
    found = phrases.hits(d, t, "id", "text")
    want = brute(texts, terms)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    texts = [x for x in texts if x[0] != 7]
    found = phrases.hits(d.where("id <> 7"), t, "id", "text")
    spans = []
    for i, _ in texts:
        end = 0
        for h in sorted((h for h in want if h[0] == i), key=lambda h: (h[1], -h[2])):
            if h[1] >= end:
                spans.append(h)
                end = h[1] + h[2]
    spans = [s for s in spans if s[0] != 7]
    assert sorted((tuple(r) for r in phrases.leftmost_longest(found, "id").collect()), key=str) == sorted(spans, key=str)


def test_no_terms_no_texts(spark):
    d = spark.createDataFrame([(1, "a b")], "id int, text string")
    none = spark.createDataFrame([], "term string")
    assert phrases.hits(d, none, "id", "text").count() == 0
    assert phrases.leftmost_longest(phrases.hits(d.where("false"), spark.createDataFrame([("a",)], "term string"), "id", "text"), "id").count() == 0
    many = spark.createDataFrame([("w " * n,) for n in range(1, 80)], "term string")
    with pytest.raises(ValueError):
        phrases.hits(d, many, "id", "text")


def test_many_phrases_are_shuffled_not_broadcast(spark):
    d = spark.range(200).select(F.col("id"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" hot phrase y"), (F.col("id") % 7).cast("string")).alias("text"))
    t = spark.range(30_000).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" hot")).alias("term")).unionByName(spark.createDataFrame([("hot phrase",)], "term string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        found = phrases.hits(d, t, "id", "text")
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_terms_are_verified_in_time(spark):
    terms = {f"term{i}x": f"wort{i}x" for i in range(300)}
    rows = [(1, "term1x and TERM2x and term250x", "wort1x term250x"), (2, "nothing", "nothing"), (3, None, "x"), (4, " ".join(terms), "")]
    d = spark.createDataFrame(rows, "id int, s string, t string")
    began = time.time()
    got = {r.id: r.r for r in d.select("id", lexicon.verify_and_fix(F.col("s"), F.col("t"), terms).alias("r")).collect()}
    assert time.time() - began < 60
    assert (got[1].text, got[1].fixed, got[1].missing) == ("wort1x wort250x", 1, ["term2x→wort2x"])
    assert (got[2].text, got[2].fixed, got[2].missing) == ("nothing", 0, []) and got[3].text == "x"
    assert got[4].missing == [f"term{i}x→wort{i}x" for i in range(10)]
    assert d.select(lexicon.verify_and_fix(F.col("s"), F.col("t"), {})["text"].alias("x")).first().x == "wort1x term250x"


@pytest.mark.parametrize("known", [True, False])
def test_runs_that_are_no_phrase_stay_where_they_are(spark, monkeypatch, known):
    """The words are read once for all lengths, and few runs besides the hits go to the join; without a bitmap all do."""
    if not known:
        monkeypatch.setattr(phrases, "MOST_PHRASES", 0)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(100)) + " hot phrase here") for i in range(150)] + [(900, None), (901, ""), (902, "here"), (903, "hot phrase")]
    terms = ["hot phrase", "hot phrase here", "here", "w3x4 w3x5", *(f"no{i} such{i} run{i}" for i in range(500))]
    d, t = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    found = phrases.hits(d, t, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1
    joined = found.collect()
    assert sorted((tuple(r) for r in joined), key=str) == brute(texts, terms)
    lengths = [1, 2, 3]
    marked = phrases._bitmap(phrases.prepared(t), lengths, 16) if known else None
    runs = d.select(F.explode(phrases._likely(phrases._hashes(phrases.words(F.col("text"))), lengths, 16, marked))).count()
    assert runs < len(joined) + 1000 if known else runs == 150 * (103 + 102 + 101) + 1 + 2 + 1


def test_counts_read_the_words_once(spark):
    plan = registry.QUERIES["phrase_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1

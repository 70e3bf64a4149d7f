"""A page is searched for tags once, however many names it has."""

from collections import Counter

from pyspark.sql import functions as F

from quirefold.functions import text
from quirefold.plans import registry


def test_counts_and_deltas(spark):
    names = [f"t{i}" for i in range(100)] * 3 + ["T1", "p"]
    html = "".join(f"<{n}>x</{n}>" for n in names)
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "none < 5")], "id int, html string")
    counts, deltas = text.tag_counts(F.col("html")), text.tag_delta(F.col("html"), F.replace("html", F.lit("<p>"), F.lit("<P><q>")))
    got = {r.id: (r.n, r.d) for r in pages.select("id", counts.alias("n"), deltas.alias("d")).collect()}
    assert got[1][0] == Counter(n.lower() for n in names) and {k: tuple(v) for k, v in got[1][1].items()} == {"q": (0, 1)}
    assert got[2] == (None, None) and got[3] == ({}, {}) and got[4] == ({}, {})


def test_searched_once(spark):
    plan = registry.QUERIES["tag_deltas"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # the page and its edit

"""The chain of cleaners: failures stay with their stage, figures by observation equal the report."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quirefold.operators import chain
from quirefold.operators.chain import Stage
from quirefold.plans import chain_queries


def boom(text):
    if "x" in text:
        raise ValueError("no x " + "y" * 500)
    return text + "!", {"marks": 1, "length": len(text)}


STAGES = [
    Stage("up", F.upper, kinds=(9,)),
    Stage("down", F.lower),
    Stage("boom", function=boom),
    Stage("drop", function=lambda t: None if t.startswith("n") else t, kinds=(9, 2)),
    Stage("twice", lambda c: F.concat(c, c)),
    Stage("gone", lambda c: F.lit(None).cast("string")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, 9, "Ab", "old"), (2, 9, "xyz", "old"), (3, 2, "No", "old"), (4, 0, None, None), (5, None, "", None), (6, 9, "é" * 300_000, None), (6, 9, "n", None)]
    return spark.createDataFrame(rows, "id int, kind int, content string, trail string")


def test_chain(docs):
    out = chain.run(docs, STAGES, kind="kind").collect()
    assert [(r.id, r.content) for r in out if r.id < 6] == [(1, "ab!ab!"), (2, "xyzxyz"), (3, "no!no!"), (4, None), (5, "!!")]
    by = {(r.id, s.stage): s for r in out for s in r.trail}
    assert by[2, "boom"].status == "failed" and by[2, "boom"].error.startswith("ValueError: no x yyy") and len(by[2, "boom"].error) < 180
    assert by[3, "up"].status == "skipped" and by[5, "up"].status == "skipped" and by[5, "drop"].status == "skipped"
    assert by[3, "drop"].status == "empty" and not by[3, "drop"].changed
    assert all(by[4, s.name].status == "skipped" for s in STAGES)
    assert by[1, "gone"].status == "empty" and by[1, "gone"].chars_out == 6
    assert [s.stage for s in out[0].trail] == [s.name for s in STAGES]


def test_observed_in_the_same_pass(docs):
    watched = Observation("cleaners")
    out = chain.observe(chain.run(docs, STAGES, kind="kind"), STAGES, watched)
    out.write.format("noop").mode("overwrite").save()
    got = {f["stage"]: f for f in chain.figures(watched, STAGES)}
    want = {r.stage: r.asDict() for r in chain.report(chain.run(docs, STAGES, kind="kind")).collect()}
    assert set(got) == set(want) and got["boom"]["failed"] == 1 and got["boom"]["ms"] > 0
    for s, f in got.items():
        assert all(f[k] == want[s][k] for k in ("rows", "changed", "failed", "skipped", "empty"))
    assert {(r.stage, r.name, r.n) for r in chain.counts(chain.run(docs, STAGES, kind="kind")).collect()} == {("boom", "marks", 5), ("boom", "length", 2 + 2 + 0 + 300_000 + 1)}


def test_one_python_pass_and_a_small_plan(docs):
    many = [Stage(f"s{i}", lambda c: F.regexp_replace(c, "a(?=b)", "ba")) for i in range(12)] + [Stage(f"p{i}", function=str.strip) for i in range(4)]
    df = chain.run(docs, many)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(plan) < 200_000
    assert df.count() == 7


def test_bad_stages(docs):
    with pytest.raises(ValueError):
        Stage("neither")
    with pytest.raises(ValueError):
        chain.run(docs, [STAGES[0], STAGES[0]])


def test_empty(docs):
    assert chain.run(docs.where("false"), STAGES).collect() == [] and chain.report(chain.run(docs.where("false"), STAGES)).collect() == []


def test_pages_hold_failures_and_changes(spark):
    rows = {r.stage: r for r in chain_queries.cleaner_report(spark, "/root/testdata/sf0.001").collect()}
    assert 0 < rows["paragraphs"].failed < rows["paragraphs"].rows and rows["emphasis"].changed and rows["margins"].changed > rows["emphasis"].rows / 3

"""Python steps hold the objects of a few rows at a time, however large Arrow's batches are."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quirefold.functions import pieces
from quirefold.operators import chain, edits, inline, lexicon, toc
from quirefold.plans import registry
from quirefold.sources import html, spans

N = 1000
PAGE = "<html><body><h1>the title of</h1><p><b>and</b> der</p><footer>f</footer></body></html>"
TERMS = {"the": "THE", "of": "OF"}


def given(monkeypatch):
    """The functions handed to F.arrow_udf."""
    got = []
    real = F.arrow_udf

    def kept(f=None, *a, **b):
        if callable(f):
            got.append(f)
        return real(f, *a, **b)

    monkeypatch.setattr(F, "arrow_udf", kept)
    return got


def small(out, fields=None):
    """All rows, none of the results with more than a piece's."""
    out = list(out)
    assert max(len(x) for x in out) <= pieces.ROWS and sum(len(x) for x in out) == N
    return [v for x in out for v in x.to_pylist()]


def test_replace_terms(spark, monkeypatch):
    got = given(monkeypatch)
    lexicon.replace_terms(TERMS)
    texts = pa.array([None if i % 10 == 0 else f"the {i} of" for i in range(N)])
    rows = small(got[-1](iter([texts])))
    assert rows[1] == {"text": "THE 1 OF", "hits": [{"term": "the", "start": 0}, {"term": "of", "start": 6}]} and rows[0] == {"text": None, "hits": []}
    assert small(got[-1](iter([texts[:300], texts[300:300], texts[300:]]))) == rows


def test_one_pass_over_the_texts(spark):
    plan = registry.QUERIES["lexicon_hits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def mapped(monkeypatch, spark, build):
    """What the function handed to mapInArrow gives for one batch."""
    got = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema, *a: got.append(f) or spark.createDataFrame([], schema))
    build()
    return got[-1]


def test_edits(spark, monkeypatch):
    pages = spark.createDataFrame([], "page_id long, html string")
    run = mapped(monkeypatch, spark, lambda: spans.elements(pages, "page_id", "html", {"h1"}))
    assert small(run(iter([pa.RecordBatch.from_pydict({"id": list(range(N)), "html": [PAGE] * N})])))[-1]["title"] == "the title of"
    files = spark.createDataFrame([], "book long, place long, file string, html string")
    run = mapped(monkeypatch, spark, lambda: toc.headings(files))
    small(run(iter([pa.RecordBatch.from_pydict({"key": [{"book": 1, "place": i, "file": "f"} for i in range(N)], "html": [PAGE] * N})])))
    got = given(monkeypatch)
    edits.edited(pages, spark.createDataFrame([], "page_id long, position int, locator string, kind string, value string"), "page_id", "html")
    todo = pa.array([[{"position": 1, "locator": "/html[1]/body[1]/h1[1]", "kind": "text", "value": "x"}] if i % 2 else None for i in range(N)])
    assert small(got[-1](iter([(pa.array([PAGE] * N), todo)])))[1]["html"] == PAGE.replace("the title of", "x")
    edits.retitled(pages.html, pages.html, pages.html)
    assert small(got[-1](iter([(pa.array([PAGE] * N), pa.array(["der"] * N), pa.array(["z"] * N))])))[5]["texts"] == 1
    inline.protected(pages.html)
    small(got[-1](iter([pa.array([PAGE] * N)])))


def test_chunk_html(spark, monkeypatch):
    run = mapped(monkeypatch, spark, lambda: html.chunk_html(spark.createDataFrame([], "page_id long, html string"), "page_id", "html"))
    out = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(N)), "html": [PAGE] * N})])))
    assert max(len(set(x.column("id").to_pylist())) for x in out) <= pieces.ROWS and sum(len(x) for x in out) == 2 * N


def test_chain(spark, monkeypatch):
    got = given(monkeypatch)
    stage = chain.Stage("twice", function=lambda t: (t * 2, {"n": 1}))
    chain.run(spark.createDataFrame([], "content string"), [stage])
    rows = small(got[-1](iter([(pa.array(["ab"] * N), pa.array([0] * N))])))
    assert rows[-1]["text"] == "abab" and rows[-1]["trail"][0]["counts"] == [("n", 1)]


def test_replaced_texts_in_pieces(spark, monkeypatch):
    got = given(monkeypatch)
    registry.QUERIES["lexicon_replaced_all"](spark, "/root/testdata/sf0.001")
    assert small(got[-1](iter([pa.array(["the der"] * N)])))[-1]["text"] == "THE DER"


def test_pieces_of_long_texts_are_small(spark, monkeypatch):
    """64 rows may be the whole 64 MB of a batch: the bytes of a piece are bounded too, and one long row goes alone."""
    got = given(monkeypatch)
    seen = []
    pieces.arrow_udf(lambda x, y: seen.append((x.nbytes, y.nbytes)) or x, "string")
    texts = pa.array(["the " * 25_000 if i % 3 else None for i in range(90)] + ["of " * 700_000] + ["x"] * 9)
    out = list(got[-1](iter([(texts, pa.array(range(100)))])))
    assert [v for x in out for v in x.to_pylist()] == texts.to_pylist()
    assert all(a + b <= pieces.BYTES or len(x) == 1 for (a, b), x in zip(seen, out, strict=True)) and len(out) < 50
    batches = list(pieces.pieces(iter([pa.RecordBatch.from_arrays([texts], ["t"])])))
    assert all(x.nbytes <= pieces.BYTES or len(x) == 1 for x in batches) and pa.Table.from_batches(batches).column("t").to_pylist() == texts.to_pylist()


def test_a_long_text_is_replaced_in_little_memory(spark, monkeypatch):
    got = given(monkeypatch)
    registry.QUERIES["lexicon_replaced_all"](spark, "/root/testdata/sf0.001")
    text = "the der\r\nof " * 100_000
    given_texts = [pa.array([text])]
    tracemalloc.start()
    try:
        rows = [v for x in got[-1](iter(given_texts)) for v in x.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == [{"text": "THE DER\r\nOF " * 100_000}] and most < 8 * len(text)

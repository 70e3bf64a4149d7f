import io
import json
import zipfile

from pyspark.sql import functions as F

from quirefold.operators import lexicon, ordered
from quirefold.sources import books
from quirefold.sources.html import chunk_html


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_chunks(spark):
    pages = [
        (1, '<body><div class="main"><p>First paragraph.</p><p>Second paragraph.</p></div></body>'),
        (2, "<div><p>Leaf only.</p></div>"),
        (3, '<p>Body</p><p class="footnoteg">Smith said so. And more.</p><div class="caption">A map</div><p>End</p>'),
        (4, '<p class="footnote">4 Orlov 1998, vol. 7, see doi: 10.55/quire</p><p> </p><div class="figure"><img/>x</div>'),
        (5, None),
    ]
    c = chunk_html(spark.createDataFrame(pages, "id int, html string"), "id", "html").orderBy("id", "sequence")
    got = rows(c, "id", "sequence", "text", "strategy", "skipped", "caption")
    assert got == [
        (1, 1, "First paragraph.", "html", None, False),
        (1, 2, "Second paragraph.", "html", None, False),
        (2, 1, "Leaf only.", "html", None, False),
        (3, 1, "Body", "html", None, False),
        (3, 2, "Smith said so. And more.", "text_nodes", None, False),
        (3, 3, "A map", "html", None, True),
        (3, 4, "End", "html", None, False),
        (4, 1, "4 Orlov 1998, vol. 7, see doi: 10.55/quire", "text_nodes", "reference", False),
        (4, 2, "x", "html", "image", False),
    ]
    assert rows(c.where("id = 1"), "locator") == [("/body[1]/div[1]/p[1]",), ("/body[1]/div[1]/p[2]",)]


def test_books(spark, tmp_path):
    chapters = [("b1", "T & t", 2, "<p>two</p>"), ("b1", "T & t", 1, "<p>one</p>"), ("b2", None, 1, "<p>x</p>")]
    out = books.write_books(spark.createDataFrame(chapters, "book string, title string, position int, html string"), f"{tmp_path}/out")
    (tmp_path / "in").mkdir()
    for r in out.collect():
        (tmp_path / "in" / f"{r.book}.epub").write_bytes(r.content)
    (tmp_path / "in" / "bad.epub").write_bytes(b"no zip")
    items = books.read_books(spark, f"{tmp_path}/in")
    assert items.where("position = 0").select("name").distinct().collect()[0][0] == "mimetype"
    assert items.where("error is not null").count() == 1
    html = items.where("item_type = 9 and name like 'c%'").select(F.regexp_extract("content", "<p>(.*)</p>", 1).alias("t"))
    assert sorted(r.t for r in html.collect()) == ["one", "two", "x"]
    target = spark.createDataFrame([(b, "x/c0001.xhtml") for b in {r.book for r in items.where("error is null").collect()}], "book string, target string")
    assert {r.name for r in books.find_member(items.where("error is null"), target).collect()} == {"c0001.xhtml"}


def test_decoding(spark):
    raw = [(1, "plain é".encode()), (2, "漢字測試".encode("big5")), (3, None)]
    got = dict(rows(spark.createDataFrame(raw, "id int, b binary").withColumn("t", books.decode_text(F.col("b"))), "id", "t"))
    assert got == {1: "plain é", 2: "漢字測試", 3: None}


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'Front'\n---\n# Head\ntext")
    (tmp_path / "b.md").write_text("# Head\ntext")
    (tmp_path / "c.md").write_text("text")
    assert sorted(r.title for r in books.read_markdown(spark, f"{tmp_path}/*.md").collect()) == ["Front", "Head", "c"]
    (tmp_path / "g.json").write_text(json.dumps({"Smith": " 史 ", "": "x", "A": ""}))
    assert rows(books.read_glossary(spark, f"{tmp_path}/g.json"), "src", "dst") == [("Smith", "史")]
    (tmp_path / "v.jsonl").write_text('{"ip": "1.1.1.1"}\nbroken\n{"ip": "2.2.2.2"}\n')
    assert books.read_json_lines(spark, f"{tmp_path}/v.jsonl", "ip string").count() == 2


def test_lexicon(spark):
    df = spark.createDataFrame([(1, "雲端運算與雲端"), (2, None), (3, "none")], "id int, t string")
    terms = {"雲端": "云", "雲端運算": "云计算"}
    got = df.select("id", lexicon.replace_terms(terms)("t").alias("r")).select("id", "r.text", F.size("r.hits").alias("n")).collect()
    assert [tuple(r) for r in got] == [(1, "云计算與云", 2), (2, None, 0), (3, "none", 0)]
    short = df.where("id = 1").select(lexicon.replace_terms(terms, "shortest")("t").alias("r")).select("r.text").first()[0]
    assert short == "云運算與云"
    t = {"New York City": "a", "York": "b", "city": "c"}
    spans = spark.createDataFrame([("new york city and york, City",)], "t string").select(lexicon.relevant_terms(F.col("t"), t).alias("s")).first().s
    assert [(s.start, s.term) for s in spans] == [(0, "New York City"), (18, "York"), (24, "city")]
    fix = spark.createDataFrame([("Smith met Lee in Rome", "Smith 見 李")], "a string, b string").select(lexicon.verify_and_fix(F.col("a"), F.col("b"), {"Smith": "史密斯", "Lee": "李", "Rome": "羅馬"}).alias("f")).first().f
    assert (fix.text, fix.fixed, fix.missing) == ("史密斯 見 李", 1, ["Rome→羅馬"])


def test_batches(spark):
    items = [[(40, False), (50, False), (20, False), (5, True), (10, False)]]
    df = spark.createDataFrame([(i,) for i in items], "items array<struct<cost:long,single:boolean>>")
    assert df.select(ordered.greedy_batches(F.col("items"), 100).alias("b")).first().b == [0, 0, 1, 2, 3]

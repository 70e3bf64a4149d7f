"""As-of joins, running values, tables of contents, edits and rewritten packages against plain computations."""

import html as html_lib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.operators import edits, ordered, toc
from quirefold.plans import page_queries
from quirefold.sources import formats


@pytest.mark.parametrize(("width", "inclusive"), [(1, True), (7, False), (7, True), (10_000, True)])
def test_as_of(spark, width, inclusive):
    rng = random.Random(width)
    left = [(rng.choice([1, 2, None]), rng.randrange(300), i) for i in range(250)]
    right = [(rng.choice([1, 2, None]), rng.randrange(300), rng.choice(["a", "b", "c"]) + str(i)) for i in range(40)] + [(3, 1, "alone")]
    a = spark.createDataFrame(left, "k int, at int, id int")
    b = spark.createDataFrame(right, "k int, at int, v string")
    got = {r.id: r.last for r in ordered.as_of(a, b, ["k"], "at", F.col("v"), "last", width, inclusive).collect()}
    for k, at, i in left:
        before = [(p, v) for q, p, v in right if q == k and (p < at or inclusive and p == at)]
        assert got[i] == max(before, default=(0, None))[1]
    assert len(got) == len(left)


def test_as_of_one_hot_key(spark):
    a = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.col("id") * 3).alias("at"))
    b = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("at"), F.col("id").alias("v"))
    out = ordered.as_of(a, b, ["k"], "at", F.col("v"), "last", width=64)
    assert out.where("last <> least(499, at div 100)").count() == 0 and out.count() == 20_000
    sizes = out.groupBy(F.expr("at div 64")).count().agg(F.max("count")).first()[0]
    assert sizes <= 64


def test_running_max_empty(spark):
    e = spark.createDataFrame([], "k int, at long, v int")
    assert ordered.running_max(e, ["k"], "at", {"m": F.col("v")}).columns == ["k", "at", "v", "m"]
    assert ordered.as_of(e, e, ["k"], "at", F.col("v"), "last").count() == 0


FILES = [
    (1, 0, "a/nav.xhtml", "<h1>Contents</h1>"),
    (1, 1, "a/1.xhtml", '<h1 id="one">One <i> &amp; </i>a half</h1><h2></h2><h2>1.2</h2><p style="text-align:center"><b>A centred title</b></p><h3>Deep</h3><h2>Next</h2>'),
    (1, 2, "a/2.xhtml", "<h4>Lost</h4><p style='text-align: center; font-weight: bold'>Deep and centred</p><p style='text-align:center;font-weight:bold'>short</p>" + "<h1>" + "x" * 201 + "</h1>"),
    (1, 3, "a/next-reads.html", "<h1>More</h1>"),
    (1, 4, "a/3.html", None),
    (2, 1, "1.html", "<h2>Other</h2>" * 3),
    (None, 1, "n.html", "<h2>No book</h2>"),
]


def test_rebuilt(spark):
    files = spark.createDataFrame(FILES, "book int, place int, file string, html string")
    got = [(r.book, r.file, r.level, r.title, r.anchor, r.parent and (r.parent >> 20, r.parent & 0xFFFFF)) for r in toc.rebuilt(toc.headings(files)).orderBy("book", "at").collect()]
    assert got == [
        (None, "n.html", 2, "No book", "toc_anchor_0", None),
        (1, "a/1.xhtml", 1, "One&a half", "one", None),
        (1, "a/1.xhtml", 2, "1.2", "toc_anchor_0", (1, 0)),
        (1, "a/1.xhtml", 3, "Deep", "toc_anchor_1", (1, 1)),
        (1, "a/1.xhtml", 2, "Next", "toc_anchor_2", (1, 0)),
        (1, "a/1.xhtml", 2, "A centred title", "toc_anchor_3", (1, 0)),
        (1, "a/2.xhtml", 4, "Lost", "toc_anchor_4", (1, 4)),
        (1, "a/2.xhtml", 2, "Deep and centred", "toc_anchor_5", (1, 0)),
        (2, "1.html", 2, "Other", "toc_anchor_0", None),
        (2, "1.html", 2, "Other", "toc_anchor_1", None),
        (2, "1.html", 2, "Other", "toc_anchor_2", None),
    ]


def test_parents_by_a_stack(spark):
    rng = random.Random(5)
    levels = [rng.randrange(1, 7) for _ in range(400)]
    files = [(9, i, f"{i}.html", "".join(f"<h{k}>t{k}</h{k}>" for k in levels[i * 10 : i * 10 + 10])) for i in range(40)]
    got = [r.parent for r in toc.rebuilt(toc.headings(spark.createDataFrame(files, "book int, place int, file string, html string")), width=toc.ROOM * 3).orderBy("at").collect()]
    stack, want = [], []
    for i, k in enumerate(levels):
        while stack and stack[-1][0] >= k:
            stack.pop()
        want.append(stack[-1][1] if stack else None)
        stack.append((k, i // 10 * toc.ROOM + i % 10))
    assert got == want


def test_localised(spark):
    found = toc.headings(spark.createDataFrame(FILES, "book int, place int, file string, html string"))
    rows = [(1, "a/1.xhtml", "one", "x"), (1, "a/1.xhtml", "none", "y"), (1, "a/2.xhtml", "", "z"), (1, "a/2.xhtml", None, " THE  book’s "), (2, "1.html", "", "Page 7"), (2, "gone.html", "q", "kept"), (2, "", "", None)]
    entries = spark.createDataFrame(rows, "book int, file string, fragment string, title string")
    books = spark.createDataFrame([(1, "The book's", " 书 ")], "book int, original string, translated string")
    got = {(r.file, r.fragment): r.new_title for r in toc.localised(entries, found, books, {"notes": "注释"}).collect()}
    assert got == {("a/1.xhtml", "one"): "One & a half", ("a/1.xhtml", "none"): "y", ("a/2.xhtml", ""): "z", ("a/2.xhtml", None): "书", ("1.html", ""): "第7页", ("gone.html", "q"): "kept", ("", ""): None}
    alone = toc.localised(entries.where("file = '1.html'"), found).collect()
    assert [r.new_title for r in alone] == ["Other"]


PAGE = "<body>\n<P class=x>One <b>two</b>\t&amp; three</P><p/><div><p>Four</p> <p id='k'>Five</p></div>\r\n</body>"


def test_retitle():
    r = edits.retitle
    page = '<title>A &amp; B</title><!-- A & B --><p class="A & B">A &amp; B, A & B; <b>A</b> &amp; B &copy;&eacute;</p><script>A & B</script>'
    new = '<title>C &lt;D&gt;</title><!-- A & B --><p class="A & B">C &lt;D&gt;, C &lt;D&gt;; <b>A</b> &amp; B &copy;&eacute;</p><script>A & B</script>'
    assert r(page, " A & B ", "C <D> ") == (new, 1, 2)
    for old in (None, "", " "):
        assert r(page, old, "C <D>") == (new.split("<!--")[0] + page[page.index("<!--") :], 1, 0)
    for nothing in (None, "", " "):
        assert r(page, "A & B", nothing) == (page, 0, 0)
    assert r("", "a", "b") == ("", 0, 0) and r("aaa", "aa", "b") == ("ba", 0, 1) and r("a&amp;aa", "aa", "b") == ("a&amp;b", 0, 1)
    assert r("<title>new a</title><p>a", "a", "new a") == ("<title>new a</title><p>new a", 0, 1)  # a new title that holds the old one is set once
    assert r("<p>x &#65;</p>", "A", "Z")[0] == "<p>x Z</p>" and r("<p>x &#65;</p>", "&#65;", "Z")[2] == 0


def test_retitled_places_against_unescaped_text():
    rng = random.Random(5)
    for _ in range(500):
        raw = "".join(rng.choice(["a", "b", "&amp;", "&lt;", "&#97;", " "]) for _ in range(rng.randint(0, 20)))
        old = "".join(rng.choice("ab&<") for _ in range(rng.randint(1, 3)))
        got, _, n = edits.retitle(f"<p>{raw}</p>", old, "Q")
        assert html_lib.unescape(got[3:-4]) == html_lib.unescape(raw).replace(old, "Q") and n == html_lib.unescape(raw).count(old)


def test_retitled_nulls(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (2, "<p>a", None, "b"), (3, "<p>a", "a", None), (4, "<p>a", "a", "b")], "id int, html string, o string, t string")
    got = {r.id: tuple(r.d) for r in docs.select("id", edits.retitled(docs.html, docs.o, docs.t).alias("d")).collect()}
    assert got == {1: (None, 0, 0), 2: ("<p>a", 0, 0), 3: ("<p>a", 0, 0), 4: ("<p>b", 0, 1)}
    assert docs.where("id > 4").select(edits.retitled(docs.html, docs.o, docs.t)).collect() == []


def test_edits():
    e = lambda *x: edits.apply(PAGE, list(x))
    one, five = "/body[1]/p[1]", "/body[1]/div[1]/p[2]"
    assert e((one, "text", "A < B")) == (PAGE.replace("One ", "A &lt; B").replace("two", "").replace("\t&amp; three", ""), [])
    assert e((one, "inner", "<p class='y'>new <i>x</i></p>")) == (PAGE.replace("One <b>two</b>\t&amp; three", "new <i>x</i>"), [])
    assert e((one, "inner", "<i>x</i> y")) == (PAGE.replace("One <b>two</b>\t&amp; three", "<i>x</i> y"), [])
    assert e((one, "id", "n"), (five, "id", "m")) == (PAGE.replace("<P class", '<P id="n" class'), [])
    html, wrong = e(("/body[1]/div[1]", "inner", "z"), (five, "text", "no"), ("/body[1]/p[9]", "text", "no"), (one, "what", ""))
    assert html == PAGE.replace("<p>Four</p> <p id='k'>Five</p>", "z") and len(wrong) == 3
    assert e() == (PAGE, [])


def test_edited_rows(spark):
    docs = spark.createDataFrame([(1, PAGE, "k"), (2, None, None), (3, PAGE, None), (None, PAGE, None)], "id int, html string, problems string").drop("problems")
    todo = spark.createDataFrame([(1, 2, "/body[1]/p[1]", "text", "second"), (1, 1, "/body[1]/p[1]", "text", "first"), (2, 1, "/p[1]", "text", "x"), (7, 1, "/p[1]", "text", "x"), (3, 1, None, None, None)], "id int, position int, locator string, kind string, value string")
    got = {r.id: (r.html, len(r.problems)) for r in edits.edited(docs, todo, "id", "html").collect()}
    assert got[1][0].startswith("<body>\n<P class=x>first<b></b></P>") and got[1][1] == 1
    assert got[2] == (None, 0) and got[3] == (PAGE, 1) and got[None] == (PAGE, 0)


def test_rewritten_package(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "in").mkdir()
    for b in ("x", "y"):
        with zipfile.ZipFile(tmp_path / "in" / f"{b}.epub", "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
            for n in ("b.html", "a.html", "z/style.css"):
                z.writestr(n, f"{b} {n} \r\n", zipfile.ZIP_DEFLATED)
    changed = spark.createDataFrame([("x", "a.html", b"new")], "book string, name string, content binary")
    edits.rewrite_books(spark, str(tmp_path / "in"), changed, str(tmp_path / "out"))
    for b in ("x", "y"):
        with zipfile.ZipFile(tmp_path / "out" / f"{b}.epub") as z:
            assert z.namelist() == ["mimetype", "b.html", "a.html", "z/style.css"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED
            assert z.read("a.html") == (b"new" if b == "x" else b"y a.html \r\n") and z.read("z/style.css") == f"{b} z/style.css \r\n".encode()


def test_queries_have_every_case(spark):
    sf = "/root/testdata/sf0.01"
    t = page_queries.toc_rebuilt(spark, sf)
    assert t.where("parent is not null").count() > 50 and t.select("level").distinct().count() == 4
    titles = page_queries.toc_titles(spark, sf)
    assert titles.where("title <> new_title").count() > 50 and titles.where("fragment like 'own%' and title <> new_title").count() > 0
    assert page_queries.paragraph_context(spark, sf).where("heading is not null and link is not null").count() > 500

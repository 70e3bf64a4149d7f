"""The parse with places against the standard library's parser, walked from the top down; inline marks and repairs."""

import glob
import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.operators import inline
from quirefold.sources import html as chunks
from quirefold.sources.spans import BLOCKS, VOID, Document, elements, spliced

PAGES = [h or "" for p in glob.glob("/root/testdata/sf0.01/pages.parquet") for h in pq.read_table(p)["html"].to_pylist()]


class Tree(HTMLParser):
    """Elements as nested lists [tag, attributes, index, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [["", {}, 1, []]]

    def handle_starttag(self, tag, attrs):
        index = 1 + sum(isinstance(c, list) and c[0] == tag for c in self.open[-1][3])
        node = [tag, dict(reversed(attrs)), index, []]
        self.open[-1][3].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][3].append(data)


def blocks_from_the_top(html):
    """(locator, tag, text, note, caption, image) of leaf blocks with text, each looked at from the root down."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    out = []

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node[3])

    def tags(node):
        return [t for c in node[3] if isinstance(c, list) for t in (c[0], *tags(c))]

    def visit(node, path, words):
        path = f"{path}/{node[0]}[{node[2]}]" if node[0] else ""
        if node[0] not in ("", "html", "body"):
            words = [*words, " ".join(v for k in chunks.WORDS if (v := node[1].get(k)))]
        below = tags(node)
        if node[0] in BLOCKS and not BLOCKS & set(below) and text(node).strip():
            image = bool({"img", "svg", "image"} & set(below))
            out.append((path, node[0], text(node).strip(), any(chunks.NOTE.search(w) for w in words), any(chunks.CAPTION.search(w) for w in words) and not image, image))
        for c in node[3]:
            if isinstance(c, list):
                visit(c, path, words)

    visit(tree.open[0], "", [])
    return out


def same_blocks(html):
    got = [(r[1], r[2], r[3], r[6] == "text_nodes", r[8], r[7] == "image") for r in chunks.chunks_of(html)]
    assert got == blocks_from_the_top(html), html


def test_all_pages():
    assert len(PAGES) > 200
    for h in PAGES:
        same_blocks(h)


TOKENS = ["<p>", "</p>", "<div class='caption'>", "</div>", "<b>", "</b>", '<span class="note-text" id=x>', "</span>", "<br>", "<br/>", "<img src='a>b'>", "<li>", "</li>", "a &amp; b", " ", "<script>if(a<b){'</p>'}</script>", "<!-- <p> -->", "< 5", "<P>", "</DIV>", "<p/>", "<sup>1</sup>", '<a id="p1"></a>', "é"]
soup = st.lists(st.sampled_from(TOKENS), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(soup)
def test_random_documents(html):
    same_blocks(html)
    doc = Document(html)
    for x in doc.nodes:
        assert x.start < x.inner <= x.stop <= x.end and html[x.start] == "<" and html[x.inner - 1] == ">"
        assert x.parent.number < 0 or (x.parent.inner <= x.start and x.end <= x.parent.stop)
        assert not x.closed or re.fullmatch(rf"</{x.tag}[^>]*>", html[x.stop : x.end], re.I)
    assert all(a < b for a, b in doc.texts) and sorted(doc.texts) == doc.texts


def test_deep_and_long():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    (row,) = chunks.chunks_of(deep)
    assert row[3] == "x" and row[1].count("/") == 20_000
    assert len(chunks.chunks_of("<p>word</p>" * 50_000)) == 50_000


@settings(max_examples=400, deadline=None)
@given(soup, st.randoms())
def test_marks(html, rng):
    text, marks = inline.protect(html)
    assert inline.restore(text, marks) == html
    assert inline.problem(text, marks) is None or inline.problem(text, marks) == "nesting"
    rest = inline.MARK.sub("", text)
    assert not any(x.tag not in BLOCKS for x in Document(rest).nodes) or "<" in inline.MARK.sub("", "".join(rng.sample(text, len(text))))
    if inline.problem(text, marks) is None:
        # text may change as it likes, as long as the marks stay in order
        changed = "".join(p if inline.MARK.fullmatch(p) else p.replace("a", "Z") for p in re.split(r"(\[\[EPUB_TAG_\d+_\w+\]\])", text))
        assert inline.problem(changed, marks) is None
        if marks:
            gone = rng.choice(marks)[0]
            lost = text.replace(gone, "")
            assert inline.problem(lost, marks) == "missing"
            fixed = inline.realign(lost, marks)
            assert fixed is None or (inline.problem(fixed, marks) is None and inline.MARK.sub("", fixed) == inline.MARK.sub("", text))
            assert inline.problem(text + gone, marks) == "repeated" and inline.realign(text + gone, marks) == text
        assert inline.problem(text + "[[EPUB_TAG_9999_SELF]]", marks) == "unknown"
        assert inline.realign(text + "[[EPUB_TAG_9999_SELF]]", marks) == text


def test_marks_by_hand():
    assert inline.protect('a <em>b<br/>c</em> <a id="x"></a>') == ("a [[EPUB_TAG_0_OPEN]]b[[EPUB_TAG_1_SELF]]c[[EPUB_TAG_0_CLOSE]] [[EPUB_TAG_2_SELF]]", [("[[EPUB_TAG_0_OPEN]]", "<em>"), ("[[EPUB_TAG_1_SELF]]", "<br/>"), ("[[EPUB_TAG_0_CLOSE]]", "</em>"), ("[[EPUB_TAG_2_SELF]]", '<a id="x"></a>')])
    text, marks = inline.protect("[[EPUB_TAG_3_OPEN]] <b>x</b>")
    assert text == "[[EPUB_TAG_3_OPEN]] [[EPUB_TAG_4_OPEN]]x[[EPUB_TAG_4_CLOSE]]"
    assert inline.restore(text, marks) == "[[EPUB_TAG_3_OPEN]] <b>x</b>"
    text, marks = inline.protect("<b>x</b><i>y</i>")
    crossed = text.replace("[[EPUB_TAG_0_CLOSE]]", "").replace("y", "y[[EPUB_TAG_0_CLOSE]]")
    assert inline.problem(crossed, marks) == "nesting" and inline.realign(crossed, marks) is None
    assert inline.realign("x[[EPUB_TAG_0_CLOSE]]y", marks) == "[[EPUB_TAG_0_OPEN]]x[[EPUB_TAG_0_CLOSE]][[EPUB_TAG_1_OPEN]]y[[EPUB_TAG_1_CLOSE]]"


@pytest.mark.parametrize(
    ("source", "translated", "html", "done"),
    [
        ('<a id="p1"></a>One <a name="n"></a>two', "一二", '<a id="p1"></a><a name="n"></a>一二', True),
        ('<a id="p1"></a>One', '<i id="p1"></i>一', '<i id="p1"></i>一', False),
        ("One<sup><a id='r'></a>1</sup> two<sup>2</sup>", "一 ", "一<sup><a id='r'></a>1</sup><sup>2</sup>", True),
        ('<span class="x big">O</span>nce', " &amp;一", ' <span class="x big">&amp;</span>一', True),
        ('<span class="s">All of it</span>', "全部", '<span class="s">全部</span>', True),
        (' <span class="s">All <em>of</em></span>', "<em>全部</em>", '<span class="s"><em>全部</em></span>', True),
        ('<span class="s">All</span> of it', "全部", "全部", False),
        ("<em>All</em> of it", "全部", "全部", False),
        ("<em>All</em>", "<em>全</em><b>部</b>", "<em>全</em><b>部</b>", False),
        ("plain", "", "", False),
    ],
)
def test_repairs(source, translated, html, done):
    assert inline.repair(source, translated) == (html, done)


def test_columns(spark):
    rows = [(1, "<em>x</em>", None), (2, None, None), (3, "", ""), (4, "x" * 200_000 + "<b>y</b>", "sorry, no"), (5, "<sup>1</sup>Six words are in this very source", "一二三"), (6, "<sup>1</sup>Six words are in this very source", "Six words are in this very source")]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    p = df.withColumn("p", inline.protected(F.col("s")))
    back = p.withColumn("r", inline.restored(F.col("p.text"), F.col("p.marks"))).orderBy("id").collect()
    assert [r.r.html if r.r else None for r in back] == [r[1] for r in rows] and all(r.r is None or r.r.problem is None for r in back)
    got = {r.id: tuple(r.x) for r in df.select("id", inline.repaired(F.col("s"), F.col("t")).alias("x")).collect()}
    assert got == {1: ("", False), 2: ("", False), 3: ("", False), 4: ("sorry, no", False), 5: ("一二三<sup>1</sup>", True), 6: ("Six words are in this very source", False)}


def test_elements(spark):
    df = spark.createDataFrame([(1, '<div><h1 id="a"> One <b>two </b></h1><p><a href="x&amp;y" name="n">z</a></div>'), (2, None), (3, "none")], "id int, html string")
    got = [tuple(r) for r in elements(df, "id", "html", {"h1", "a"}).orderBy("number").collect()]
    assert got == [(1, 1, "h1", 5, 37, 0, "a", None, "Onetwo"), (1, 4, "a", 40, 72, 3, "n", "x&y", "z")]


def test_spliced():
    rng = random.Random(1)
    for _ in range(50):
        cuts = sorted(rng.sample(range(30), 6))
        edits = [(cuts[i], cuts[i + 1], rng.choice(["", "new"])) for i in (4, 0, 2)]
        html = "".join(rng.choices("ab<>", k=30))
        want = html
        for a, b, t in sorted(edits, reverse=True):
            want = want[:a] + t + want[b:]
        assert spliced(html, edits) == want

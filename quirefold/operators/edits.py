"""Edits of HTML at locators, everything else unchanged byte for byte, and packages with changed members."""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.pieces import arrow_udf
from quirefold.sources.spans import BLOCKS, Document, spliced

KINDS = ("inner", "text", "id")
_UNIT = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);?|.", re.S)


def apply(html: str, edits: list[tuple[str, str, str]]) -> tuple[str, list[str]]:
    """The document after edits (locator, kind, value), and what could not be done.

    inner: the element's content becomes the value (of a value that is one
    such element itself, its content); text: its first text that is not blank
    becomes the value, its other texts go, tags stay; id: the open tag gets
    the id, unless it has one.  Of edits that meet, the first in the list is
    done.
    """
    doc = Document(html)
    known = {x.locator(): x for x in doc.nodes} if len(edits) > 1 else None
    done: list[tuple[int, int, str]] = []
    wrong: list[str] = []
    for locator, kind, value in edits:
        node = known.get(locator) if known is not None else next((x for x in doc.nodes if x.locator() == locator), None)
        if node is None:
            wrong.append(f"{locator}: no such element")
            continue
        if kind == "inner":
            new = Document(value)
            top = next((x for x in new.nodes if x.tag in BLOCKS), new.nodes[0] if new.nodes else None)
            own = top is not None and top.tag == node.tag
            mine = [(node.inner, node.stop, value[top.inner : top.stop] if own else value)]
        elif kind == "text":
            texts = [(a, b) for a, b in doc.inside(node) if html_lib.unescape(html[a:b]).strip()]
            text = html_lib.escape(value, quote=False)
            mine = [(a, b, "" if i else text) for i, (a, b) in enumerate(texts)] or [(node.inner, node.inner, text)]
        elif kind == "id":
            at = node.start + 1 + len(node.tag)
            mine = [] if node.attribute("id") else [(at, at, f' id="{html_lib.escape(value)}"')]
        else:
            wrong.append(f"{locator}: unknown kind {kind}")
            continue
        if any(a < d and c < b or (a, b) == (c, d) for a, b, _ in mine for c, d, _ in done):
            wrong.append(f"{locator}: meets an earlier edit")
            continue
        done += mine
    return spliced(html, done), wrong


def edited(docs: DataFrame, edits: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``docs`` with ``html_col`` after their edits (id, position, locator, kind, value) in order of position, and ``problems``.

    The edits of one document meet in its row.  Documents without edits, and
    null ones, stay as they are.
    """
    rows = edits.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("position", "locator", "kind", "value"))).alias("_edits"))

    def run(html: pa.Array, todo: pa.Array) -> pa.Array:
        out = []
        for h, es in zip(html.to_pylist(), todo.to_pylist(), strict=True):
            new, wrong = (h, []) if h is None or not es else apply(h, [(e["locator"] or "", e["kind"] or "", e["value"] or "") for e in es])
            out.append({"html": new, "problems": wrong})
        return pa.array(out, pa.struct([("html", pa.string()), ("problems", pa.list_(pa.string()))]))

    done = arrow_udf(run, "struct<html:string,problems:array<string>>")
    joined = docs.join(rows, F.col(id_col) == F.col("_id"), "left").withColumn("_done", done(F.col(html_col), F.col("_edits")))
    rest = [F.col("_done.html").alias(c) if c == html_col else F.col(c) for c in docs.columns]
    return joined.select(*rest, "_done.problems")


def _places(raw: str, wanted: str) -> list[tuple[int, int]]:
    """Where ``wanted``, a text, stands in ``raw``, text with character references: offsets in ``raw``, leftmost, apart."""
    if "&" not in raw:
        return [m.span() for m in re.finditer(re.escape(wanted), raw)]
    if wanted not in html_lib.unescape(raw):
        return []
    at, plain, size = {}, [], 0  # offset in the plain text of each place in raw between two references
    for m in _UNIT.finditer(raw):
        at[size] = m.start()
        plain.append(html_lib.unescape(m[0]))
        size += len(plain[-1])
    at[size] = len(raw)
    text, out, i = "".join(plain), [], 0
    while (i := text.find(wanted, i)) >= 0:
        if i in at and i + len(wanted) in at:
            out.append((at[i], at[i + len(wanted)]))
            i += len(wanted)
        else:
            i += 1
    return out


def retitle(html: str, original: str | None, translated: str | None, raw: bool = False) -> tuple[str, int, int]:
    """The document under its new title, how many title elements and how many other places changed.

    Each ``title`` holds the new title alone; in all other texts (not in
    scripts, styles, comments and attributes) each place of the old title
    becomes the new one.  A blank new title changes nothing, a blank old one
    only the title elements.  What does not change keeps its bytes.  raw: the
    old title is as the source has it, and is found as it stands there, even
    where a character reference goes on after it.
    """
    old, new = (original or "").strip(), (translated or "").strip()
    if not new:
        return html, 0, 0
    doc, text = Document(html), html_lib.escape(new, quote=False)
    titles = [x for x in doc.nodes if x.tag == "title" and not any(u.tag == "title" for u in x.up() if u is not x)]
    named = [(x.inner, x.stop, text) for x in titles if "".join(t.strip() for t in doc.strings(x)) != new]
    apart = {span for x in titles for span in doc.inside(x)}
    other = [(a + i, a + j, text) for a, b in doc.texts if old and (a, b) not in apart for i, j in ([m.span() for m in re.finditer(re.escape(old), html[a:b])] if raw else _places(html[a:b], old))]
    return spliced(html, named + other), len(named), len(other)


def retitled(html: Column, original: Column, translated: Column, raw: bool = False) -> Column:
    """struct<html, titles, texts>: ``retitle`` of each row; null HTML stays null."""

    def run(html: pa.Array, original: pa.Array, translated: pa.Array) -> pa.Array:
        rows = zip(html.to_pylist(), original.to_pylist(), translated.to_pylist(), strict=True)
        out = [(None, 0, 0) if h is None else retitle(h, o, t, raw) for h, o, t in rows]
        return pa.array([{"html": h, "titles": n, "texts": k} for h, n, k in out], pa.struct([("html", pa.string()), ("titles", pa.int32()), ("texts", pa.int32())]))

    return arrow_udf(run, "struct<html:string,titles:int,texts:int>")(html, original, translated)


def rewrite_books(spark: SparkSession, source: str, changed: DataFrame, target: str) -> None:
    """Packages of ``source`` written to ``target`` with changed members (book, name, content): order and all other members stay.

    ``changed.book`` is a package's file name without its suffix.  Needs the
    data sources (``formats.register``).
    """
    members = spark.read.format("books").load(source).where("error is null")
    stem = F.regexp_replace(F.substring_index("book", "/", -1), r"\.[^.]*$", "")
    members = members.select(stem.alias("book"), "position", "name", "content")
    new = changed.select("book", "name", F.col("content").alias("_new"))
    out = members.join(new, ["book", "name"], "left").select("book", "position", "name", F.coalesce("_new", "content").alias("content"))
    out.repartition("book").sortWithinPartitions("book", "position").write.format("books").mode("append").save(target)

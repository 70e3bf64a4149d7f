"""Tables of contents: headings of all files, their tree, anchors, and titles for existing entries.

A book's files are ordered by ``place``.  Everything that runs along a book
(anchor numbers, parents, places) is carried in two levels, so a book may be
larger than a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.pieces import pieces
from quirefold.operators import ordered
from quirefold.sources.spans import Document, References

LEVELS = {f"h{k}": k for k in range(1, 7)}
# Files that hold no chapters; the longest title; the lengths of a paragraph that may be a heading.
NO_CHAPTER = r"nav|\.ncx$|next-reads"
LONGEST = 200
PARAGRAPH = (10, 100)
#: Headings of one file at most this many places apart from the next file's.
ROOM = 1 << 20

_FIELDS = [("number", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("anchor", pa.string()), ("start", pa.int32()), ("locator", pa.string()), ("spaced", pa.string())]


def _bold_and_centred(doc: Document, node, bold_starts: list[int]) -> bool:
    style = node.attribute("style") or ""
    if "text-align" not in style or "center" not in style:
        return False
    return ("font-weight" in style and "bold" in style) or any(node.inner <= s < node.stop for s in bold_starts)


def headings_of(html: str, references: References = None) -> list[tuple]:
    """(number, level, title, anchor, start, locator, spaced title) of a file: its headings, then centred bold paragraphs that read like one."""
    doc = Document(html, references)
    found, rest = [], []
    bold = [x.start for x in doc.nodes if x.tag in ("b", "strong")]
    for x in doc.nodes:
        if x.tag in LEVELS:
            pieces = [s.strip() for s in doc.strings(x)]
            title = "".join(pieces)
            if title and len(title) <= LONGEST:
                found.append((LEVELS[x.tag], title, x, " ".join(" ".join(p for p in pieces if p).split())))
        elif x.tag == "p" and "style" in x.attrs and _bold_and_centred(doc, x, bold):
            title = "".join(s.strip() for s in doc.strings(x))
            if PARAGRAPH[0] < len(title) < PARAGRAPH[1]:
                rest.append((2, title, x, title))
    titles = {f[1] for f in found}
    for r in rest:
        if r[1] not in titles:
            titles.add(r[1])
            found.append(r)
    return [(i, level, title, x.attribute("id") if level and x.tag in LEVELS else None, x.start, x.locator(), spaced) for i, (level, title, x, spaced) in enumerate(found)]


def headings(files: DataFrame, html: str = "html", references: References = None) -> DataFrame:
    """(book, place, file, number, level, title, anchor, start, locator, spaced) from files (book, place, file, html); files without chapters are left out.

    Titles have ``references`` read as in ``Document``.
    """
    base = F.lower(F.substring_index("file", "/", -1))
    rows = files.where(~base.rlike(NO_CHAPTER)).select(F.struct("book", "place", "file").alias("key"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, at = [], []
            for i, text in enumerate(batch.column("html").to_pylist()):
                got = headings_of(text or "", references)
                out += got
                at += [i] * len(got)
            cols = list(zip(*out, strict=True)) or [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True))], names=["key", *(f for f, _ in _FIELDS)])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, number int, level int, title string, anchor string, start int, locator string, spaced string")
    return out.select("key.*", "number", "level", "title", "anchor", "start", "locator", "spaced")


def rebuilt(found: DataFrame, width: int = ROOM * 64) -> DataFrame:
    """Headings as entries: ``own`` (it had an anchor), ``anchor``, ``at`` (place in the book) and ``parent`` (the last heading of a higher level before it).

    A heading without an anchor gets ``toc_anchor_`` and a number that counts
    such headings along the book, from 0.
    """
    rows = found.withColumns({"at": F.col("place").cast("long") * ROOM + F.col("number"), "own": F.coalesce(F.col("anchor") != "", F.lit(False))})
    rows = ordered.running_sum(rows.withColumn("_new", F.when(F.col("own"), 0).otherwise(1)), ["book"], "at", "_new", "_count", width)
    rows = rows.withColumn("anchor", F.when(F.col("own"), F.col("anchor")).otherwise(F.concat(F.lit("toc_anchor_"), (F.col("_count") - 1).cast("string")))).drop("_new", "_count")
    last = {f"_last{k}": F.when(F.col("level") == k, F.col("at")) for k in range(1, 6)}
    rows = ordered.running_max(rows, ["book"], "at", last, width)
    above = F.greatest(*[F.when(F.col("level") > k, F.col(f"_last{k}")) for k in range(1, 6)])
    return rows.withColumn("parent", above).drop(*last)


def meaningful(title: Column) -> Column:
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    return (flat != "") & (F.length(flat) <= LONGEST) & ~flat.rlike(r"^[\d\s._-]+$")


def localised(entries: DataFrame, found: DataFrame, books: DataFrame | None = None, common: dict[str, str] | None = None) -> DataFrame:
    """Entries (book, file, fragment, title, ...) with ``new_title``.

    In turn: the book's translated title for an entry with its original one
    (``books``: book, original, translated), a common title's translation,
    'page N', the heading at (file, fragment), the file's first heading if the
    file has one entry only, else the title as it is.
    """
    heads = found.where(meaningful(F.col("spaced")))
    anchor = F.trim("anchor")
    exact = heads.where(anchor != "").groupBy("book", "file", anchor.alias("fragment")).agg(F.max_by("spaced", F.struct("place", "number")).alias("_exact"))
    first = heads.groupBy("book", "file").agg(F.min_by("spaced", F.struct("place", "number")).alias("_first"))
    single = entries.where("file <> ''").groupBy("book", "file").agg(F.count("*").alias("_entries")).where("_entries = 1")
    out = entries.join(exact, ["book", "file", "fragment"], "left").join(single.join(first, ["book", "file"]).drop("_entries"), ["book", "file"], "left")
    flat = F.replace(F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))), F.lit("’"), F.lit("'"))
    rules = []
    if books is not None:
        b = books.select(F.col("book").alias("_book"), F.lower(F.trim(F.regexp_replace("original", r"\s+", " "))).alias("_original"), F.trim("translated").alias("_translated"))
        out = out.join(b, F.col("book") == F.col("_book"), "left")
        rules.append(F.when((F.col("_translated") != "") & (flat == F.col("_original")), F.col("_translated")))
    if common:
        rules.append(F.create_map(*[F.lit(x) for kv in common.items() for x in kv])[flat])
        number = F.regexp_extract(flat, r"^page\s+(\d+)$", 1)
        rules.append(F.when(number != "", F.concat(F.lit("第"), number, F.lit("页"))))
    out = out.withColumn("new_title", F.coalesce(*rules, F.when(F.col("fragment") != "", F.col("_exact")), F.col("_first"), F.col("title")))
    return out.select(*entries.columns, "new_title")

"""Block chunks of HTML documents.

A chunk is a leaf block (a block element without another block inside) with
text.  Each gets a number within its document, a locator (the path of
elements, each with its place among equally named siblings) and a way of
translation; image blocks and notes that only cite are numbered but skipped.
The parse of one document is a small helper; documents are dealt by Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.pieces import pieces
from quirefold.sources.spans import Document

#: Attributes whose words tell captions and notes.
WORDS = ("class", "id", "role", "epub:type", "type")
# The class words of captions and notes.
IMAGES = {"img", "svg", "image"}
CAPTION = re.compile("figcaption|caption|figure|photo|picture|image|diagram|illustration|illus|legend|credit", re.I)
NOTE = re.compile("footnotes?|footnoteg|endnotes?|rearnotes?|note[-_ ]?text", re.I)
# Marks of a citation, and of a reference.
CITED = re.compile(r"https?://|www\.|doi\s*:|isbn\s*:", re.I)
SIGNALS = re.compile(r"https?://|www\.|doi\s*:|isbn\s*:|\b(?:vol|no|pp?|eds?)\.\s*\d|\b(?:19|20)\d{2}\b", re.I)

SCHEMA = "sequence int, locator string, tag string, text string, word_count int, char_count int, strategy string, skipped string, caption boolean"


def chunks_of(html: str) -> list[tuple]:
    doc = Document(html or "")
    images = sorted(x.start for x in doc.nodes if x.tag in IMAGES)
    kinds = {-1: (False, False)}  # whether an element, or one around it, is a note or a caption
    for x in doc.nodes:
        note, caption = kinds[x.parent.number]
        own = "" if x.tag in ("html", "body") or "=" not in x.attrs else " ".join(v for k in WORDS if (v := x.attribute(k)))
        kinds[x.number] = (note or bool(NOTE.search(own)), caption or bool(CAPTION.search(own))) if own else (note, caption)
    out = []
    for node in doc.leaf_blocks():
        raw = "".join(doc.strings(node))
        text = raw.strip()
        if not text:
            continue
        flat = " ".join(text.split())
        i = bisect_left(images, node.inner)
        note, caption = kinds[node.number]
        image = i < len(images) and images[i] < node.stop
        sentences = len(re.findall(r"[.!?](?:\s|$)", flat))
        cites = note and sentences <= 1 and ((bool(CITED.search(flat)) and len(flat) <= 300) or len(SIGNALS.findall(flat)) >= 2)
        out.append(
            (len(out) + 1, node.locator(), node.tag, text, len(text.split()), len(raw), "text_nodes" if note else "html", "image" if image else "reference" if cites else None, caption and not image)
        )
    return out


def chunk_html(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row a chunk; null HTML gives none."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, at = [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                found = chunks_of(html)
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", *names])

    out = docs.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)

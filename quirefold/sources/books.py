"""Packaged books and text files as tables.

Files are read by Spark's binaryFile source, so any file system that Spark
knows will do; one package is unpacked by a small helper in its task.  A
broken package gives one row with ``error`` set.
"""

from __future__ import annotations

import html as html_lib
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HTML, CSS, OTHER = 9, 2, 0


def item_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\.x?html?$"), HTML).when(low.endswith(".css"), CSS).otherwise(OTHER)


def read_books(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """(book, position, name, content, error, item_type), one row a package member."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(book, i, n, z.read(n), None) for i, n in enumerate(z.namelist()) if not n.endswith("/")]
                except (zipfile.BadZipFile, KeyError, RuntimeError) as e:
                    rows = [(book, -1, None, None, f"{type(e).__name__}: {e}")]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["book", "position", "name", "content", "error"])

    items = files.select("path", "content").mapInArrow(run, "book string, position int, name string, content binary, error string")
    return items.withColumn("item_type", item_type(F.col("name")))


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 in the JVM; other encodings tried strictly in turn in Python."""

    @F.pandas_udf("string")
    def fallback(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            for codec in ("utf-8-sig", "big5", "gbk", "gb18030", "cp950"):
                try:
                    return bytes(b).decode(codec)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "replace")

        return raw.map(one)

    fine = F.is_valid_utf8(content.cast("string"))
    return F.when(content.isNull(), F.lit(None)).when(fine, content.cast("string")).otherwise(fallback(F.when(~fine, content)))


def find_member(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Members (book, position, name) for targets (book, target): exact or suffix match, else base name; the first wins."""
    base = lambda c: F.substring_index(c, "/", -1)
    pairs = members.join(targets.withColumn("base", base(F.col("target"))), (members["book"] == targets["book"]) & (base(members["name"]) == F.col("base"))).drop(targets["book"])
    exact = (F.col("name") == F.col("target")) | F.col("name").endswith(F.concat(F.lit("/"), F.col("target")))
    return pairs.groupBy("book", "target").agg(F.min_by("name", F.struct(F.when(exact, 0).otherwise(1), "position")).alias("name"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines drop."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of terms, blank entries dropped."""
    terms = F.from_json("value", "map<string,string>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(terms).alias("src", "dst"))
    return rows.select(F.trim("src").alias("src"), F.trim("dst").alias("dst")).where("src <> '' and dst <> ''")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, body): front matter's title, else the first heading, else the file's stem."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", "")
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(
        named(F.regexp_replace(F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1), "^[\"']|[\"']$", "")),
        named(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)),
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1),
    )
    return t.select("path", title.alias("title"), body.alias("body"))


def read_archives(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Archived chunks, nested folders too; the later file wins for each (chapter_id, chunk_id)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    rest = [c for c in rows.columns if c not in ("chapter_id", "chunk_id")]
    last = rows.groupBy("chapter_id", "chunk_id").agg(F.max_by(F.struct(*rest), "file").alias("r"))
    return last.select("chapter_id", "chunk_id", *[F.col(f"r.{c}") for c in rest])


def write_books(chapters: DataFrame, path: str) -> DataFrame:
    """Packs chapters (book, title, position, html) as EPUB 3; returns (book, content) and writes it as Parquet.

    A book is one file, so its chapters meet in one task by nature.
    """

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["position"])
        title = html_lib.escape(rows[0]["title"] or "Untitled")
        items = [f"c{i + 1:04d}.xhtml" for i in range(len(rows))]
        nav = "".join(f'<li><a href="{n}">{i + 1}</a></li>' for i, n in enumerate(items))
        manifest = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(items))
        spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(items)))
        page = '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{}</title></head><body>{}</body></html>'
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
            z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
            z.writestr("nav.xhtml", page.format(title, f'<nav epub:type="toc"><ol>{nav}</ol></nav>'))
            z.writestr("content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{html_lib.escape(str(rows[0]["book"]))}</dc:identifier><dc:title>{title}</dc:title><dc:language>zh</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{manifest}</manifest><spine>{spine}</spine></package>')
            for n, r in zip(items, rows, strict=True):
                z.writestr(n, page.format(title, re.sub(r"<[/]?(?:html|body|head)[^>]*>", "", r["html"] or "")), zipfile.ZIP_DEFLATED)
        return pa.table({"book": [str(rows[0]["book"])], "content": pa.array([buffer.getvalue()], pa.binary())})

    out = chapters.select("book", "title", "position", "html").groupBy("book").applyInArrow(build, "book string, content binary")
    out.write.mode("overwrite").parquet(path)
    return chapters.sparkSession.read.parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

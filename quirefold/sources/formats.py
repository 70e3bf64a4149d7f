"""Files as Python data sources: ``spark.read.format("books" | "markdown" | "archives")``.

``register(spark)`` makes them known.  Partitions are planned from a listing:
small files share one, up to ``partition_bytes`` (option, 64 MB), and a
package larger than that is split by its members, which a task reads by
seeking.  A schema given with ``.schema(...)`` is all that is produced, so
without ``content`` (or ``body``) nothing is unpacked; filters on a file's or
member's name and type are pushed down and leave files unopened.  A file that
cannot be read is one row with ``error`` set.

Paths are URIs that pyarrow knows (file, hdfs, s3, gs) or absolute paths, seen
alike by all machines.  ``books`` can be written too, one package a book.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

PARTITION_BYTES = 64 << 20
#: Bytes of content in one batch.
BATCH_BYTES = 8 << 20


@dataclass
class Part(ds.InputPartition):
    """Files of one task, each with the range of its members (None: all)."""

    files: list[tuple[str, int, int | None]]

    def __init__(self, files: list[tuple[str, int, int | None]]):
        super().__init__(0)
        self.files = files


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _listing(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of the file itself, by name."""
    store, at = _open(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", "."))]
    return sorted((scheme + f.path, f.size) for f in files)


def holds(f: ds.Filter, value) -> bool:
    """Whether a value passes a pushed filter (SQL's nulls: none but IsNull passes)."""
    if isinstance(f, ds.Not):
        return value is not None and not holds(f.child, value)
    if isinstance(f, ds.IsNull):
        return value is None
    if value is None:
        return isinstance(f, ds.EqualNullSafe) and f.value is None
    if isinstance(f, ds.IsNotNull):
        return True
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return value == f.value
    if isinstance(f, ds.In):
        return value in f.value
    if isinstance(f, ds.StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, ds.StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, ds.StringContains):
        return f.value in value
    tests = {ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b}
    return tests[type(f)](value, f.value)


def _attribute(f: ds.Filter) -> tuple:
    return _attribute(f.child) if isinstance(f, ds.Not) else f.attribute


class FileReader(ds.DataSourceReader):
    """Plans files into partitions and reads them one by one."""

    #: The column that names the file; and further columns known before a file's content is read.
    file_column = "path"
    early: tuple[str, ...] = ()
    pattern = "*"

    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", self.pattern)
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.columns = schema.fieldNames()
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _attribute(f)[0] in (self.file_column, *self.early) and len(_attribute(f)) == 1:
                self.filters.append(f)
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        return all(holds(f, value) for f in self.filters if _attribute(f)[0] == column)

    def split(self, path: str, size: int) -> list[tuple[tuple[str, int, int | None], int]]:
        """A file's pieces with their sizes: the file as a whole, if a format cannot cut it."""
        return [((path, 0, None), size)]

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        room = 0
        for path, size in _listing(self.path, self.pattern):
            if not self.passes(self.file_column, path):
                continue
            for piece, n in self.split(path, size):
                if not parts or n > room:
                    parts.append(Part([]))
                    room = self.limit
                parts[-1].files.append(piece)
                room -= n
        return parts or [Part([])]

    def rows(self, path: str, first: int, last: int | None) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for path, first, last in partition.files:
            for row in self.rows(path, first, last):
                held.append(row)
                size += 100 + sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
                if size > BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(f.name) for r in rows], f.type) for f in self.arrow]
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, f.type) for f in self.arrow]))


def item_type(name: str) -> int:
    """9: document, 2: style sheet, 0: anything else."""
    return 9 if re.search(r"\.x?html?$", name.lower()) else 2 if name.lower().endswith(".css") else 0


class BookReader(FileReader):
    file_column, early, pattern = "book", ("name", "item_type"), "*.epub"

    def split(self, path, size):
        if size <= self.limit:
            return [((path, 0, None), size)]
        store, at = _open(path)
        try:
            with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                sizes = [i.compress_size for i in z.infolist()]
        except Exception:  # a task will say what is wrong with it
            return [((path, 0, None), size)]
        pieces, first, n = [], 0, 0
        for i, s in enumerate(sizes):
            if n and n + s > self.limit:
                pieces.append(((path, first, i), n))
                first, n = i, 0
            n += s
        return [*pieces, ((path, first, len(sizes)), n)]

    def rows(self, path, first, last):
        store, at = _open(path)
        try:
            with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                for i, info in enumerate(z.infolist()[first:last], first):
                    name = info.filename
                    if name.endswith("/") or not self.passes("name", name) or not self.passes("item_type", item_type(name)):
                        continue
                    row = {"book": path, "position": i, "name": name, "item_type": item_type(name), "size": info.file_size}
                    try:
                        if "content" in self.columns:
                            row["content"] = z.read(info)
                    except Exception as e:  # one broken member leaves the others
                        row["error"] = f"{type(e).__name__}: {e}"
                    yield row
        except Exception as e:
            if first == 0 and not any(_attribute(x)[0] in self.early for x in self.filters):
                yield {"book": path, "position": -1, "error": f"{type(e).__name__}: {e}"}


class MarkdownReader(FileReader):
    pattern = "*.m*d*"

    def rows(self, path, first, last):
        if not re.search(r"\.(md|markdown)$", path.lower()):
            return
        row: dict = {"path": path}
        try:
            if set(self.columns) - {"path"}:
                store, at = _open(path)
                with store.open_input_stream(at) as f:
                    text = f.read().decode("utf-8-sig")
                row["meta"], row["body"] = front_matter(text)
                heading = re.search(r"^#\s+(.+)$", row["body"], re.M)
                stem = re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
                row["title"] = row["meta"].get("title") or (heading[1].strip() if heading else "") or stem
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
        yield row


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The keys of a leading ``---`` block (plain ``key: value`` lines), and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    meta = {}
    for line in m[1].splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip() and not key[0].isspace():
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            meta[key.strip()] = value.strip()
    return meta, text[m.end() :]


class ArchiveReader(FileReader):
    """JSON files of one chunk, or a list of chunks, each."""

    file_column, pattern = "file", "*.json"

    def rows(self, path, first, last):
        try:
            store, at = _open(path)
            with store.open_input_stream(at) as f:
                found = json.loads(f.read())
            for i, x in enumerate(found if isinstance(found, list) else [found]):
                if not isinstance(x, dict):
                    yield {"file": path, "position": i, "error": f"not an object: {str(x)[:80]}"}
                    continue
                text = lambda k, x=x: None if x.get(k) is None else str(x[k])
                yield {"file": path, "position": i, "attempt_id": text("attempt_id"), "chapter_id": text("chapter_id"), "chunk_id": text("chunk_id"), "payload": json.dumps(x, ensure_ascii=False)}
        except Exception as e:
            yield {"file": path, "position": -1, "error": f"{type(e).__name__}: {e}"}


class BookWriter(ds.DataSourceArrowWriter):
    """Rows (book, position, name, content), the rows of a book in one task and in order; overwriting replaces books of the same name."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        done: list[tuple[str, str]] = []
        book, buffer, z = None, None, None

        def finish() -> None:
            if z is not None:
                z.close()
                part = f"{at}/_{uuid.uuid4().hex}"  # a task that is run again leaves no half package
                with store.open_output_stream(part) as out:
                    out.write(buffer.getbuffer())
                done.append((part, f"{at}/{book}.epub"))

        for batch in iterator:
            for row in batch.to_pylist():
                if z is None or row["book"] != book:
                    finish()
                    book, buffer = row["book"], io.BytesIO()
                    z = zipfile.ZipFile(buffer, "w")
                    if row["name"] != "mimetype":
                        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo(row["name"]), bytes(row["content"] or b""), zipfile.ZIP_STORED if row["name"] == "mimetype" else zipfile.ZIP_DEFLATED)
        finish()
        message = ds.WriterCommitMessage()
        message.done = done
        return message

    def commit(self, messages) -> None:
        store, _ = _open(self.path)
        for m in messages:
            for part, target in m.done if m else []:
                store.move(part, target)

    def abort(self, messages) -> None:
        store, _ = _open(self.path)
        for m in messages:
            for part, _target in m.done if m else []:
                store.delete_file(part)


class Books(ds.DataSource):
    """(book, position, name, item_type, size, content, error): one row a member of a package."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return "book string, position int, name string, item_type int, size long, content binary, error string"

    def reader(self, schema: StructType) -> BookReader:
        return BookReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"])


class Markdown(ds.DataSource):
    """(path, title, meta, body, error): title from the front matter, else the first heading, else the file's stem."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return "path string, title string, meta map<string,string>, body string, error string"

    def reader(self, schema: StructType) -> MarkdownReader:
        return MarkdownReader(schema, self.options)


class Archives(ds.DataSource):
    """(file, position, attempt_id, chapter_id, chunk_id, payload, error): one row a chunk in JSON files, folders below included."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "file string, position int, attempt_id string, chapter_id string, chunk_id string, payload string, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (Books, Markdown, Archives):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""Data sources over files: partitions, pruning, filters, broken files, and packages written and read."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.sources import formats


def ddl(text=None):
    return StructType.fromDDL(text or formats.Books({}).schema())


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def package(path, members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, c in members:
            z.writestr(n, c)
    path.write_bytes(buffer.getvalue())


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "deep").mkdir()
    for i in range(6):
        package((tmp_path / "deep" if i % 2 else tmp_path) / f"b{i}.epub", [("mimetype", "application/epub+zip"), ("a/", ""), ("a/c.xhtml", f"<p>{i}</p>" + "x" * 1000), ("s.css", "p{}")])
    package(tmp_path / "big.epub", [(f"{k}.html", "y" * 5000) for k in range(10)])
    (tmp_path / "bad.epub").write_bytes(b"no package")
    (tmp_path / "note.txt").write_text("other")
    return tmp_path


def test_partitions(known, shelf):
    reader = formats.BookReader(ddl(), {"path": str(shelf), "partition_bytes": "12000"})
    parts = reader.partitions()
    pieces = [f for p in parts for f in p.files]
    cut = [(a, b) for path, a, b in pieces if path.endswith("big.epub")]
    assert len(cut) > 3 and cut[0][0] == 0 and cut[-1][1] == 10 and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
    assert len({f[0] for f in pieces}) == 8 and len(parts) < len(pieces)
    assert len(formats.BookReader(ddl(), {"path": str(shelf)}).partitions()) == 1
    assert [p.files for p in formats.BookReader(ddl(), {"path": str(shelf / "deep"), "pattern": "none*"}).partitions()] == [[]]


def test_books(known, shelf):
    df = known.read.format("books").option("partition_bytes", "12000").load(str(shelf))
    assert df.rdd.getNumPartitions() > 4
    rows = df.collect()
    assert len(rows) == 6 * 3 + 10 + 1 and len({(r.book, r.position) for r in rows}) == len(rows)
    (bad,) = [r for r in rows if r.error]
    assert bad.book.endswith("bad.epub") and bad.position == -1 and bad.content is None
    assert {bytes(r.content)[:8] for r in rows if r.name == "a/c.xhtml"} == {f"<p>{i}</p>".encode() for i in range(6)}


def test_pruning_and_filters(known, shelf, monkeypatch):
    names = known.read.format("books").schema("book string, name string, size long").load(str(shelf)).where("name like '%.css'")
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "like" not in plan.lower() and "EndsWith" not in plan  # the source takes the filter over
    assert names.count() == 6
    docs = known.read.format("books").load(str(shelf)).where("item_type = 9 and position < 3")
    assert docs.where("error is null").count() == 6 + 3
    one = known.read.format("books").load(str(shelf)).where(F.col("book") == str(shelf / "b2.epub"))
    assert one.count() == 3 and one.rdd.getNumPartitions() == 1
    # what is not asked for is not unpacked
    reader = formats.BookReader(ddl("name string, size long"), {"path": str(shelf)})
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a: pytest.fail("unpacked"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 29


def test_broken_member(known, tmp_path):
    package(tmp_path / "b.epub", [("one.html", "1" * 50), ("two.html", "2" * 50)])
    raw = (tmp_path / "b.epub").read_bytes()
    (tmp_path / "b.epub").write_bytes(raw.replace(b"2" * 50, b"3" * 50))
    rows = {r.name: r for r in known.read.format("books").load(str(tmp_path)).collect()}
    assert bytes(rows["one.html"].content) == b"1" * 50 and rows["one.html"].error is None
    assert rows["two.html"].content is None and "CRC" in rows["two.html"].error


def test_markdown(known, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "Own: title"\ntags: x\n---\n# Heading\ntext')
    (tmp_path / "b.markdown").write_text("intro\n# The heading \nrest")
    (tmp_path / "c.md").write_text("")
    (tmp_path / "d.md").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "e.mdx").write_text("no")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in known.read.format("markdown").load(f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.md", "b.markdown", "c.md", "d.md"}
    assert (rows["a.md"].title, rows["a.md"].meta["tags"], rows["a.md"].body) == ("Own: title", "x", "# Heading\ntext")
    assert rows["b.markdown"].title == "The heading" and rows["c.md"].title == "c"
    assert rows["d.md"].error.startswith("UnicodeDecodeError") and rows["d.md"].title is None
    assert known.read.format("markdown").load(str(tmp_path)).where(F.col("path").endswith("/c.md")).count() == 1


def test_archives(known, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "1.json").write_text(json.dumps({"attempt_id": "a", "chapter_id": 1, "chunk_id": "c", "text": "old"}))
    (tmp_path / "x" / "2.json").write_text(json.dumps([{"attempt_id": "a", "chapter_id": 1, "chunk_id": "c", "text": "né"}, 5]))
    (tmp_path / "x" / "3.json").write_text("{broken")
    df = known.read.format("archives").load(str(tmp_path))
    rows = {(r.file.rsplit("/", 1)[-1], r.position): r for r in df.collect()}
    assert set(rows) == {("1.json", 0), ("2.json", 0), ("2.json", 1), ("3.json", -1)}
    assert rows["2.json", 1].error == "not an object: 5" and rows["3.json", -1].error.startswith("JSONDecodeError")
    latest = df.where("error is null and attempt_id = 'a'").groupBy("chapter_id", "chunk_id").agg(F.max_by("payload", F.struct("file", "position")).alias("p"))
    assert json.loads(latest.first().p)["text"] == "né"


def test_written_books(known, tmp_path):
    rows = [(f"b{i}", k, f"{k}.html", f"<p>{i}.{k} é</p>".encode()) for i in range(5) for k in range(7)]
    df = known.createDataFrame(rows, "book string, position int, name string, content binary")
    df.repartition(3, "book").sortWithinPartitions("book", "position").write.format("books").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"b{i}.epub" for i in range(5)]
    back = known.read.format("books").load(str(tmp_path / "out")).where("position > 0")
    assert sorted((r.book.rsplit("/", 1)[-1][:-5], r.position - 1, r.name, bytes(r.content)) for r in back.collect()) == rows
    first = known.read.format("books").load(str(tmp_path / "out")).where("position = 0").select("name", F.col("content").cast("string")).distinct().collect()
    assert [tuple(r) for r in first] == [("mimetype", "application/epub+zip")]


def test_no_such_path(known, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        known.read.format("books").load(str(tmp_path / "none")).collect()

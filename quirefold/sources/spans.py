"""HTML with places: every element and text with its offsets in the source.

``parse`` is one pass over a document's text; an end tag closes the nearest
open element of its name (and what is open inside), one without such is a
stray.  Offsets are code points, so a source can be cut and put together again
with everything else unchanged.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.pieces import pieces

# Block elements, elements without content, elements whose content is no text.
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script": re.compile(r"</script(?=[\s/>])", re.I), "style": re.compile(r"</style(?=[\s/>])", re.I)}

_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""")
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

References = tuple[tuple[str, str], ...] | None


class Node:
    """start..inner is the open tag, inner..stop the content, stop..end the end tag (empty, if there is none)."""

    __slots__ = ("attrs", "closed", "end", "index", "inner", "number", "parent", "start", "stop", "tag")

    def __init__(self, number: int, tag: str, parent: Node | None, attrs: str, start: int, inner: int, index: int):
        self.number, self.tag, self.parent, self.attrs, self.start, self.inner, self.index = number, tag, parent, attrs, start, inner, index
        self.stop = self.end = inner
        self.closed = False

    def attribute(self, name: str) -> str | None:
        for k, v in _ATTRIBUTE.findall(self.attrs):
            if k.lower() == name:
                return html_lib.unescape(v[1:-1] if v[:1] in "\"'" and v else v)
        return None

    def up(self) -> Iterator[Node]:
        node = self
        while node.parent is not None:
            yield node
            node = node.parent

    def locator(self) -> str:
        return "".join(f"/{n.tag}[{n.index}]" for n in reversed(list(self.up())))


class Document:
    """references: the character references that ``strings`` reads, in turn, as (written, meant); None: all of HTML's, also those without a semicolon."""

    def __init__(self, html: str, references: References = None):
        self.html, self.references = html, references
        #: Elements in document order, without the root.
        self.nodes: list[Node] = []
        #: Texts outside scripts and styles: (start, end).
        self.texts: list[tuple[int, int]] = []
        #: End tags that close nothing: (start, end).
        self.strays: list[tuple[int, int]] = []
        self._parse()

    def _parse(self) -> None:
        html, n = self.html, len(self.html)
        root = Node(-1, "", None, "", 0, 0, 1)
        open_, counts = [root], [{}]

        def text(a: int, b: int) -> None:
            if a < b:
                self.texts.append((a, b))

        def shut(to: int, at: int) -> None:
            while len(open_) > to:
                node = open_.pop()
                counts.pop()
                node.stop = node.end = at

        at = begin = 0
        while (lt := html.find("<", at)) >= 0:
            follows = html[lt + 1 : lt + 2]
            if follows in ("!", "?"):
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + (4 if comment else 2))
                end = n if end < 0 else end + (3 if comment else 1)
                text(begin, lt)
                at = begin = end
                continue
            if follows == "/" and (m := _CLOSE.match(html, lt)):
                text(begin, lt)
                at = begin = m.end()
                tag = m[1].lower()
                depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag), 0)
                if not depth:
                    self.strays.append((lt, at))
                    continue
                shut(depth + 1, lt)
                node = open_.pop()
                counts.pop()
                node.stop, node.end, node.closed = lt, at, True
                continue
            m = (_OPEN.match(html, lt) or _LOOSE.match(html, lt)) if follows.isalpha() and follows.isascii() else None
            if m is None:
                at = lt + 1  # no tag: part of the text
                continue
            text(begin, lt)
            at = begin = m.end()
            tag = m[1].lower()
            counts[-1][tag] = index = counts[-1].get(tag, 0) + 1
            node = Node(len(self.nodes), tag, open_[-1], m[2], lt, at, index)
            self.nodes.append(node)
            if tag in VOID or m[2].rstrip().endswith("/"):
                continue
            open_.append(node)
            counts.append({})
            if tag in RAW:
                found = RAW[tag].search(html, at)
                at = begin = found.start() if found else n
        text(begin, n)
        shut(1, n)

    def inside(self, node: Node) -> list[tuple[int, int]]:
        """Texts within an element."""
        a = bisect_left(self.texts, (node.inner, -1))
        return self.texts[a : bisect_left(self.texts, (node.stop, -1))]

    def strings(self, node: Node) -> list[str]:
        return [self._read(self.html[a:b]) for a, b in self.inside(node)]

    def _read(self, text: str) -> str:
        if self.references is None:
            return html_lib.unescape(text)
        for written, meant in self.references:
            text = text.replace(written, meant)
        return text

    def leaf_blocks(self) -> list[Node]:
        """Block elements without a block inside, found bottom-up."""
        above = set()
        for node in reversed(self.nodes):
            if (node.tag in BLOCKS or node.number in above) and node.parent.number >= 0:
                above.add(node.parent.number)
        return [x for x in self.nodes if x.tag in BLOCKS and x.number not in above]


def spliced(html: str, edits: list[tuple[int, int, str]]) -> str:
    """Replaces (start, end, text) of edits that do not overlap; all else stays."""
    out, at = [], 0
    for start, end, text in sorted(edits, key=lambda e: (e[0], e[1])):
        out += [html[at:start], text]
        at = end
    return "".join([*out, html[at:]])


def elements(docs: DataFrame, id_col: str, html_col: str, tags: set[str], references: References = None) -> DataFrame:
    """(id, number, tag, start, end, parent, anchor, href, title): elements of the given names; null HTML gives none.

    ``number`` is the place among all elements, ``parent`` that of the element
    around it; ``anchor`` is its id, else its name; ``title`` its text with
    each piece trimmed, with ``references`` read as in ``Document``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("number", pa.int32()), ("tag", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("anchor", pa.string()), ("href", pa.string()), ("title", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, at = [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                doc = Document(html or "", references)
                for x in doc.nodes:
                    if x.tag in tags:
                        rows.append((x.number, x.tag, x.start, x.end, x.parent.number, x.attribute("id") or x.attribute("name"), x.attribute("href"), "".join(s.strip() for s in doc.strings(x))))
                        at.append(i)
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], names=["id", *(f for f, _ in fields)])

    out = docs.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, number int, tag string, start int, end int, parent int, anchor string, href string, title string")
    return out.withColumnRenamed("id", id_col)

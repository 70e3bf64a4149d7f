"""Inline tags of HTML fragments: protected by marks, restored, checked, realigned and repaired.

Each inline element becomes a pair of marks (OPEN, CLOSE) around its content,
or one mark (SELF) if it has none; so do a tag that is never closed, an end
tag that closes nothing, and a script or style as a whole.  What the marks
stand for is the source's own text, so ``restored(protected(x)) == x``.
The helpers work on one fragment; Spark deals the fragments out.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import quality
from quirefold.functions.pieces import arrow_udf
from quirefold.sources.spans import BLOCKS, RAW, Document, Node, spliced

MARK = re.compile(r"\[\[EPUB_TAG_(\d+)_(OPEN|CLOSE|SELF)\]\]")
_MARKS = "array<struct<mark:string,html:string>>"


def protect(html: str) -> tuple[str, list[tuple[str, str]]]:
    """The fragment with marks, and what each stands for, in order."""
    doc = Document(html)
    taken = [int(n) for n in re.findall(r"\[\[EPUB_TAG_(\d+)_", html)]
    number = max(taken, default=-1) + 1  # a text may hold such marks already
    found: list[tuple[int, int, str, int]] = []
    skip_to = 0
    for at, item in sorted([(x.start, x) for x in doc.nodes] + [(a, (a, b)) for a, b in doc.strays], key=lambda e: e[0]):
        if isinstance(item, Node):
            if item.tag in BLOCKS:
                continue
            if item.closed and item.inner < item.stop and item.tag not in RAW:
                found += [(item.start, item.inner, "OPEN", number), (item.stop, item.end, "CLOSE", number)]
            else:
                whole = item.closed or item.tag in RAW
                found.append((item.start, item.end if whole else item.inner, "SELF", number))
        else:
            if re.match(rf"</(?:{'|'.join(BLOCKS)})\b", html[item[0] : item[1]], re.I):
                continue
            found.append((*item, "SELF", number))
        number += 1
    marks = []
    edits = []
    for start, end, kind, k in sorted(found, key=lambda e: (e[0], e[1])):
        if start < skip_to:
            continue
        skip_to = end
        mark = f"[[EPUB_TAG_{k}_{kind}]]"
        marks.append((mark, html[start:end]))
        edits.append((start, end, mark))
    return spliced(html, edits), marks


def restore(text: str, marks: list[tuple[str, str]]) -> str:
    """Marks replaced by what they stand for; unknown marks stay."""
    known = dict(marks)
    return MARK.sub(lambda m: known.get(m[0], m[0]), text)


def problem(text: str, marks: list[tuple[str, str]]) -> str | None:
    """Why a text's marks cannot be restored as they are: 'unknown', 'repeated', 'missing', 'nesting', or None."""
    known = [m for m, _ in marks]
    found = [m[0] for m in MARK.finditer(text)]
    if set(found) - set(known):
        return "unknown"
    if len(set(found)) < len(found):
        return "repeated"
    if len(found) < len(known):
        return "missing"
    stack = []
    for m in found:
        number, kind = MARK.fullmatch(m).groups()
        if kind == "OPEN":
            stack.append(number)
        elif kind == "CLOSE" and (not stack or stack.pop() != number):
            return "nesting"
    return None


def realign(text: str, marks: list[tuple[str, str]]) -> str | None:
    """The text with its marks put right, or None.

    Unknown marks and later copies go.  A missing mark is set beside the mark
    it stands beside in the source: an OPEN, or a SELF, after the nearest one
    before it that is there; a CLOSE before the nearest one after it.  The
    result counts only if marks then pair and nest.
    """
    known = [m for m, _ in marks]
    seen: set[str] = set()
    parts: list[str] = []
    at = 0
    for m in MARK.finditer(text):
        parts.append(text[at : m.start()])
        if m[0] in known and m[0] not in seen:
            seen.add(m[0])
            parts.append(m[0])
        at = m.end()
    parts.append(text[at:])
    for i, mark in enumerate(known):
        if mark in seen:
            continue
        if mark.endswith("_CLOSE]]"):
            after = next((m for m in known[i + 1 :] if m in seen), None)
            where = parts.index(after) if after else len(parts)
        else:
            before = next((m for m in reversed(known[:i]) if m in seen), None)
            where = parts.index(before) + 1 if before else 0
        parts.insert(where, mark)
        seen.add(mark)
    out = "".join(parts)
    return None if problem(out, marks) else out


def tag_counts(doc: Document) -> Counter:
    return Counter(x.tag for x in doc.nodes if x.tag not in BLOCKS)


def _text(doc: Document, node: Node) -> str:
    return "".join(s.strip() for s in doc.strings(node))


def _drop_capital(doc: Document) -> Node | None:
    return next((x for x in doc.nodes if x.tag == "span" and "big" in (x.attribute("class") or "").split() and re.fullmatch("[A-Za-z]", _text(doc, x))), None)


def _tags_of(doc: Document, node: Node) -> tuple[str, str]:
    return doc.html[node.start : node.inner], f"</{node.tag}>"


def _around_first_character(html: str, before: str, after: str) -> str:
    doc = Document(html)
    for a, b in doc.texts:
        if m := re.search(r"&(?:#\w+|\w+);|\S", html[a:b]):
            return spliced(html, [(a + m.start(), a + m.start(), before), (a + m.end(), a + m.end(), after)])
    return html


def repair(source: str, translated: str) -> tuple[str, bool]:
    """The translation with lost tags put back where that is safe; (as it was, False) if the counts do not agree then.

    Anchors without text go to the front, notes (sup) to the end, a drop
    capital around the first character, and a span around everything.
    """
    one, two = Document(source), Document(translated)
    want, have = tag_counts(one), tag_counts(two)
    if not translated or want == have or all(have[t] >= n for t, n in want.items()):
        return translated, False
    ids = {x.attribute("id") for x in two.nodes}
    anchors = [
        x for x in one.nodes
        if x.tag == "a" and not _text(one, x) and (x.attribute("id") or x.attribute("name")) and not (x.attribute("id") and x.attribute("id") in ids) and not any(u.tag == "sup" for u in x.up())
    ]
    out = "".join(source[x.start : x.end] for x in anchors) + translated
    notes = [x for x in one.nodes if x.tag == "sup"]
    if have["sup"] < len(notes):
        out = out.rstrip() + "".join(source[x.start : x.end] for x in notes)
    capital = _drop_capital(one)
    if capital is not None and tag_counts(Document(out))["span"] < want["span"]:
        out = _around_first_character(out, *_tags_of(one, capital))
    if want["span"] == 1 and tag_counts(Document(out))["span"] == 0:
        top = [x for x in one.nodes if x.parent.number < 0]
        bare = "".join(source[a:b] for a, b in one.texts if not any(x.start <= a < x.end for x in top[:1]))
        if len(top) == 1 and not bare.strip() and top[0].tag in ("span", "em", "strong", "i", "b"):
            before, after = _tags_of(one, top[0])
            out = f"{before}{out}{after}"
    return (out, True) if tag_counts(Document(out)) == want else (translated, False)


_PROTECTED = pa.struct([("text", pa.string()), ("marks", pa.list_(pa.struct([("mark", pa.string()), ("html", pa.string())])))])


def _protected(html: pa.Array) -> pa.Array:
    def one(x: str) -> dict:
        text, marks = protect(x)
        return {"text": text, "marks": [{"mark": m, "html": h} for m, h in marks]}

    return pa.array([None if x is None else one(x) for x in html.to_pylist()], _PROTECTED)


def protected(html: Column) -> Column:
    """struct(text, marks); null for null."""
    return arrow_udf(_protected, f"struct<text:string,marks:{_MARKS}>")(html)


def _restored(text: pa.Array, marks: pa.Array) -> pa.Array:
    out = []
    for t, ms in zip(text.to_pylist(), marks.to_pylist(), strict=True):
        if t is None or ms is None:
            out.append(None)
            continue
        pairs = [(m["mark"], m["html"]) for m in ms]
        wrong = problem(t, pairs)
        fixed = realign(t, pairs) if wrong else None
        out.append({"html": restore(t if fixed is None else fixed, pairs), "problem": wrong, "realigned": fixed is not None})
    return pa.array(out, pa.struct([("html", pa.string()), ("problem", pa.string()), ("realigned", pa.bool_())]))


def restored(text: Column, marks: Column) -> Column:
    """struct(html, problem, realigned): the inverse of ``protected``, also after edits."""
    return arrow_udf(_restored, "struct<html:string,problem:string,realigned:boolean>")(text, marks)


def _repaired(source: pa.Array, translated: pa.Array) -> pa.Array:
    rows = [repair(s or "", t or "") for s, t in zip(source.to_pylist(), translated.to_pylist(), strict=True)]
    return pa.array([{"html": h, "repaired": r} for h, r in rows], pa.struct([("html", pa.string()), ("repaired", pa.bool_())]))


def repaired(source: Column, translated: Column) -> Column:
    """struct(html, repaired): ``repair`` of translations that are none of: empty, an error's text, still untranslated."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(translated, F.lit(""))
    unfit = (t == "") | quality.error_like(t) | quality.untranslated_gate(s, t)
    as_is = F.struct(t.alias("html"), F.lit(False).alias("repaired"))
    run = arrow_udf(_repaired, "struct<html:string,repaired:boolean>")
    return F.when(unfit, as_is).otherwise(run(s, F.when(~unfit, t)))

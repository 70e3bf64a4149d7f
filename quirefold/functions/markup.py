"""Rewrites of HTML and CSS strings, and checks of packages, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = '<div class="epub-table-wrap">'


def wrap_tables(html: Column) -> Column:
    """Each table in a scrolling container, unless it has one."""
    return F.regexp_replace(html, r'(?is)(?<!epub-table-wrap">)(<table\b[^>]*>.*?</table>)', f"{WRAP}$1</div>")


def with_attribute(html: Column, tag: str, attribute: str, value: str) -> Column:
    """The attribute on every such tag that lacks it."""
    return F.regexp_replace(html, rf"(?i)(<{tag}\b(?![^>]*{attribute}=)[^>]*?)\s*/?>", f'$1 {attribute}="{value}">')


def kindle_css(css: Column) -> Column:
    """No colours but black, no backgrounds but light ones, no opacity; borders of one pixel at least."""
    css = F.regexp_replace(css, r"(?i)(?<![-\w])color\s*:(?!\s*(?:#000|black|inherit)\b)[^;]+;", "")
    css = F.regexp_replace(css, r"(?i)background(?:-color)?\s*:(?!\s*(?:transparent|inherit|white|#fff|none)\b)[^;]+;", "")
    css = F.regexp_replace(css, r"(?i)opacity\s*:[^;]+;", "")
    css = F.regexp_replace(css, r"(border[^:;]*:\s*)(?:0?\.\d+|0)px", "$11px")
    return F.regexp_replace(css, r"(border[^:;]*:\s*\d+)\.\d+px", "$1px")


def apple_css(css: Column, properties=("hyphens", "column-count", "column-gap", "text-size-adjust")) -> Column:
    """A -webkit- twin after each line that sets one of the properties, if the sheet has none."""

    def twins(line: Column) -> Column:
        new = [F.when(F.ltrim(line).startswith(f"{p}:") & ~css.contains(f"-webkit-{p}"), F.replace(line, F.lit(f"{p}:"), F.lit(f"-webkit-{p}:"))) for p in properties]
        return F.array_compact(F.array(line, *new))

    return F.array_join(F.flatten(F.transform(F.split(css, "\n"), twins)), "\n")


def repaired(html: Column) -> Column:
    """HTML5 doctype for old ones (the first), and no empty namespaces."""
    old = r"(?is)<!DOCTYPE\s+html\s+(?:PUBLIC|SYSTEM)[^>]*>"
    first = F.regexp_extract(html, old, 0)
    before = F.call_function("substring_index", html, first, F.lit(1))
    after = F.substring(html, F.length(before) + F.length(first) + 1, F.length(html))
    fixed = F.when(first == "", html).otherwise(F.concat(before, F.lit("<!DOCTYPE html>"), after))
    return F.regexp_replace(fixed, r'\s+xmlns=""', "")


def issues(names: Column, compressed: Column, old_doctypes: Column, empty_namespaces: Column) -> Column:
    """Codes of what a package check finds, from its member names in order and counts."""
    at = F.array_position(names, "mimetype")
    return F.array_compact(
        F.array(
            F.when(at != 1, "PKG-006"),
            F.when((at > 0) & compressed, "PKG-006"),
            F.when(old_doctypes > 0, "HTM-004"),
            F.when(empty_namespaces > 0, "RSC-005"),
        )
    )


def protected(html: Column) -> Column:
    """struct(text, tags): inline tags as numbered marks, and the tags by number."""
    pattern = r"(?i)</?(?!(?:p|div|h[1-6]|li|blockquote)\b)[a-z][^>]*>"
    tags, gaps = F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.split(html, pattern, -1)
    marked = F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit("[[TAG_"), (i - 1).cast("string"), F.lit("]]"), g)))
    return F.struct(F.array_join(marked, "").alias("text"), tags.alias("tags"))


def restored(text: Column, tags: Column) -> Column:
    """The inverse of protected()."""
    seq = F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(seq, text, lambda acc, i: F.replace(acc, F.concat(F.lit("[[TAG_"), i.cast("string"), F.lit("]]")), F.get(tags, i)))


def singleton(html: Column) -> Column:
    """Fragments translated on their own: notes, several links, drop capitals, many inline tags."""
    count = lambda t: F.regexp_count(html, F.lit(rf"(?i)<{t}\b"))
    inline = F.regexp_count(html, F.lit(r"(?i)<(?!(?:p|div|h[1-6]|li|blockquote)\b)[a-z]"))
    drop = html.rlike(r"""(?i)<span[^>]*class=["'](?:[^"']*\s)?big(?:\s[^"']*)?["'][^>]*>\s*[A-Za-z]\s*</span>""")
    return drop | (count("sup") > 0) | (count("a") >= 2) | (inline >= 4)


def lenient_json(answer: Column) -> Column:
    """The JSON object in a model's answer: code fences, talk around it and trailing commas removed."""
    body = F.regexp_replace(F.regexp_replace(F.trim(answer), "^```(?:json)?", ""), "```$", "")
    body = F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), F.trim(body))
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def keeps_space(source: Column, translated: Column) -> Column:
    """Translated text node with the source's white space around it."""
    inner = F.regexp_replace(translated, r"^\s+|\s+$", "")
    return F.when(F.coalesce(inner, F.lit("")) == "", source).otherwise(F.concat(F.regexp_extract(source, r"^\s*", 0), inner, F.regexp_extract(source, r"\s*$", 0)))


def chapter_id(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_]", "_")
    return F.when(safe == "", "chapter").otherwise(safe)


def output_suffix(traditional: Column, translate: Column, lang: Column, bilingual: Column) -> Column:
    return F.concat_ws("_", F.when(traditional, "繁体").otherwise("简体"), F.when(translate, F.concat(F.lit("翻译_"), lang)), F.when(translate & bilingual, "双语"))


def e164(phone: Column) -> Column:
    p = F.trim(phone)
    return F.when(p.startswith("+"), p).when(p.startswith("86") & (F.length(p) == 13), F.concat(F.lit("+"), p)).otherwise(F.concat(F.lit("+86"), p))


def replaced_marks(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), text)

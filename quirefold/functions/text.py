"""Text, HTML-string and name functions as column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upright form of each vertical punctuation mark, in code order of the pairs below.
VERTICAL_MARKS = "︐︑︒︓︔︕︖︵︶︷︸︹︺︽︾︿﹀﹁﹂﹃﹄"
UPRIGHT_MARKS = "，、。：；！？（）〔〕【】《》〈〉「」『』"

# Stylesheet rewrites from vertical to horizontal layout.
HORIZONTAL_CSS = (
    (r"(?i)(-webkit-|-epub-)?writing-mode\s*:\s*vertical-(?:lr|rl)\s*;?", "$1writing-mode: horizontal-tb;"),
    (r"(?i)text-orientation\s*:\s*upright\s*;?", "text-orientation: mixed;"),
    (r"(?i)direction\s*:\s*rtl\s*;?", "direction: ltr;"),
)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def visible_text(html: Column) -> Column:
    """Tags out, the five common entities decoded, white space collapsed."""
    plain = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return squeeze(plain)


def upright_punctuation(c: Column) -> Column:
    return F.translate(c, VERTICAL_MARKS, UPRIGHT_MARKS)


def horizontal_css(c: Column) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), HORIZONTAL_CSS, c)


def typography(html: Column) -> Column:
    """Ellipses and dashes in text between tags; attributes stay."""
    dots = F.regexp_replace(html, r"\.{3,}(?=[^<>]*<)", "…")
    return F.regexp_replace(dots, r"(?<![:/\-])-{2}(?![\-/>])(?=[^<>]*<)", "—")


def clean_style(style: Column) -> Column:
    """An inline style without fonts, pixel line heights and backgrounds."""
    for pattern in (r"(?i)font-family\s*:[^;]+;?", r"(?i)line-height\s*:\s*\d+px;?", r"(?i)background-color\s*:[^;]+;?"):
        style = F.regexp_replace(style, pattern, "")
    return F.trim(style)


def latin_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[A-Za-z][A-Za-z'\-]{2,}"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def cjk_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[㐀-鿿]"))


def numbers(c: Column) -> Column:
    """Number tokens, full-width digits and marks folded first."""
    folded = F.translate(c, "０１２３４５６７８９–—−：／，．", "0123456789---:/,.")
    return F.regexp_extract_all(folded, F.lit(r"\d+(?:[,\.\-:/]\d+)*"), F.lit(0))


def heading_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(squeeze(c)), r"[\s:：.。]+$", "")


def term_key(c: Column) -> Column:
    """A candidate term without edge punctuation and possessive ending."""
    return F.regexp_replace(squeeze(c), "['’]s$", "")


def safe_name(c: Column, limit: int = 120) -> Column:
    """File name without path, control and reserved characters, its stem limited."""
    base = F.regexp_replace(F.element_at(F.split(c, r"[/\\]"), -1), "[\\x00-\\x1f]", "")
    base = F.regexp_replace(base, r'[<>:"|?*]', "_")
    base = squeeze(F.regexp_replace(F.trim(base), r"^\.+", ""))
    stem, ext = F.regexp_extract(base, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(base, r"^(.*)\.([^.]*)$", 2)
    whole = F.when(base.contains("."), F.concat(F.rtrim(F.left(stem, F.lit(limit))), F.lit("."), ext)).otherwise(F.rtrim(F.left(base, F.lit(limit))))
    return F.when(base == "", F.lit("upload.bin")).otherwise(whole)


def masked_ip(c: Column) -> Column:
    """IPv4 address with its last part zeroed; anything else empty."""
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(c.rlike(rf"^{part}(\.{part}){{3}}$"), F.regexp_replace(c, r"\.[0-9]+$", ".0")).otherwise("")


def short(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.left(c, F.lit(limit - 3))), F.lit("..."))).otherwise(c)


def href_parts(c: Column) -> Column:
    """Struct of file and fragment of a link."""
    plain = F.url_decode(c)
    return F.struct(
        F.regexp_replace(F.substring_index(plain, "#", 1), r"^[./]+", "").alias("file"),
        F.when(plain.contains("#"), F.regexp_extract(plain, "#(.*)$", 1)).otherwise("").alias("fragment"),
    )


def footnote(html: Column) -> Column:
    """Struct of href, anchor, chapter and note of the first footnote link; nulls without one."""
    pattern = r"""(?i)href=["']([^"']+?\.x?html#(ch(\d+)fn(\d+)))["']"""
    get = lambda i: F.nullif(F.regexp_extract(html, pattern, i), F.lit(""))
    return F.struct(get(1).alias("href"), get(2).alias("anchor"), get(3).cast("int").alias("chapter"), get(4).cast("int").alias("note"))


def tag_counts(html: Column) -> Column:
    """Map of tag name to number of opening tags."""
    tags = F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda t: F.lower(t))

    def counted(ts: Column) -> Column:
        names = F.array_sort(F.array_distinct(ts))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(ts, lambda t: t == n))))

    # bound by a lambda, else the page is searched again for each name
    return F.transform(F.array(tags), counted)[0]


def tag_delta(a: Column, b: Column) -> Column:
    """Tags whose counts differ, with both counts."""

    def compared(ab: Column) -> Column:
        both = F.map_zip_with(ab["a"], ab["b"], lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("source"), F.coalesce(y, F.lit(0)).alias("translated")))
        return F.map_filter(both, lambda _, v: v["source"] != v["translated"])

    return F.transform(F.array(F.struct(tag_counts(a).alias("a"), tag_counts(b).alias("b"))), compared)[0]


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [c.contains(w) for w in words])

"""Rules that judge a translated segment against its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.markup import singleton
from quirefold.functions.text import any_of, cjk_chars, latin_letters, latin_words, numbers, squeeze, visible_text

# Answers that are an apology or an error and no translation.
ERROR_MARKERS = ("error:", "rate limit", "cannot translate", "can't translate", "unable to process", "i'm unable", "i am unable", "sorry,")
# Words that carry a sentence's logic.
LOGIC_MARKERS = (" not ", " never ", " unless ", " although ", " though ", " however ", " but ", " because ", " therefore ", " despite ", " rather than ")


def error_like(c: Column) -> Column:
    return any_of(F.lower(c), ERROR_MARKERS)


def same_text(a: Column, b: Column) -> Column:
    return F.lower(squeeze(a)) == F.lower(squeeze(b))


def _mostly_source(a: Column, b: Column) -> Column:
    wa, wb, latin, cjk = latin_words(a), latin_words(b), latin_letters(b), cjk_chars(b)
    kept = (wb >= F.greatest(F.lit(6), F.floor(wa * 0.7))) & (cjk < F.greatest(F.lit(6), F.floor(latin * 0.15)))
    drowned = (cjk > 0) & (wb >= 12) & (latin > F.greatest(F.lit(120.0), cjk * 2.5))
    return kept | drowned


def untranslated_audit(a: Column, b: Column) -> Column:
    """Audit rule: equal texts count from two words and twelve letters on."""
    same = same_text(a, b) & (latin_words(a) >= 2) & (latin_letters(a) >= 12)
    return (b != "") & (same | ((latin_words(a) >= 6) & _mostly_source(a, b)))


def untranslated_gate(a: Column, b: Column) -> Column:
    """Acceptance rule: nothing counts below six source words."""
    return (a != "") & (b != "") & (latin_words(a) >= 6) & (same_text(a, b) | _mostly_source(a, b))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == 0, F.lit(1.0)).otherwise(F.bround(F.length(b) / F.length(a), 3))


def missing_numbers(a: Column, b: Column) -> Column:
    """Number tokens of a that b lacks, with multiplicity, in order."""
    na, nb = numbers(a), numbers(b)
    count = lambda xs, v: F.size(F.filter(xs, lambda w: w == v))
    nth = F.transform(na, lambda v, i: F.struct(v.alias("v"), count(F.slice(na, F.lit(1), i + 1), v).alias("k")))
    return F.transform(F.filter(nth, lambda s: s["k"] > count(nb, s["v"])), lambda s: s["v"])


def audit(a: Column, b: Column) -> Column:
    """Struct of risk_level and flags, in the order the rules are asked."""
    ratio = length_ratio(a, b)
    flags = F.array_compact(
        F.array(
            F.when(b == "", "empty_translation"),
            F.when(untranslated_audit(a, b), "likely_untranslated"),
            F.when(error_like(b), "error_like_response"),
            F.when((F.length(a) >= 40) & (F.length(b) > 0) & (ratio < 0.25), "suspiciously_short_translation"),
            F.when(F.size(missing_numbers(a, b)) > 0, "numbers_missing"),
        )
    )
    fail = F.arrays_overlap(flags, F.array(*map(F.lit, ("empty_translation", "likely_untranslated", "error_like_response"))))
    return F.struct(F.when(fail, "fail").when(F.size(flags) > 0, "warn").otherwise("ok").alias("risk_level"), flags.alias("flags"))


def review_reasons(a: Column, b: Column) -> Column:
    """Why a draft deserves a second look (text rules)."""
    ratio = F.length(b) / F.greatest(F.length(a), F.lit(1))
    padded = F.concat(F.lit(" "), F.lower(a), F.lit(" "))
    return F.array_compact(
        F.array(
            F.when(F.length(a) >= 420, "long_text"),
            F.when(numbers(a) != numbers(b), "number_mismatch"),
            F.when(any_of(padded, LOGIC_MARKERS), "logic_relation"),
            F.when((ratio < 0.32) | (ratio > 2.4), "length_ratio"),
            F.when(error_like(b) | untranslated_gate(a, b), "translation_suspect"),
        )
    )


def number_tokens(c: Column) -> Column:
    """Signed numbers that stand alone (no letter, digit or underscore beside them)."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])[+-]?\d+(?:[.,:/-]\d+)*(?![A-Za-z0-9_])"), F.lit(0))


def inline_tags(html: Column) -> Column:
    """Names of the inline elements of a fragment, sorted."""
    names = F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)
    return F.array_sort(F.filter(names, lambda t: ~t.rlike("^(p|div|h[1-6]|li|blockquote)$")))


def invalid_reason(source: Column, translated: Column) -> Column:
    """The first reason why a fragment's translation cannot be taken, or null."""
    return (
        F.when(F.coalesce(translated, F.lit("")) == "", "empty")
        .when(error_like(translated), "error_response")
        .when(untranslated_gate(source, translated), "untranslated")
        .when(inline_tags(source) != inline_tags(translated), "inline_tags")
    )


def _lacking(terms: dict[str, str], source: Column, text: Column, also: Column | None = None) -> Column:
    """Whether the target of a term that the source holds is missing from a text (and was in ``also``)."""
    found = F.lit(False)
    for src, dst in terms.items():
        used = source.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])\Q{src}\E(?![\p{{L}}\p{{N}}_])") if src[:1].isascii() and src[:1].isalpha() else source.contains(src)
        was = F.lit(True) if also is None else also.contains(dst)
        found = found | (used & was & ~text.contains(dst))
    return found


def review_risks(source: Column, draft: Column, terms: dict[str, str], long_text: int = 420) -> Column:
    """Why a draft deserves a second look: all eight rules, in their order, on fragments of HTML."""
    a, b = visible_text(source), visible_text(draft)
    ratio = F.length(b) / F.greatest(F.length(a), F.lit(1))
    return F.array_compact(
        F.array(
            F.when(source.rlike(r"(?i)<h[1-6][\s>]"), "heading"),
            F.when(singleton(source), "complex_html"),
            F.when(F.length(a) >= long_text, "long_text"),
            F.when(number_tokens(a) != number_tokens(b), "number_mismatch"),
            F.when(any_of(F.concat(F.lit(" "), F.lower(a), F.lit(" ")), LOGIC_MARKERS), "logic_relation"),
            F.when((ratio < 0.32) | (ratio > 2.4), "length_ratio"),
            F.when(_lacking(terms, a, b), "glossary_missing"),
            F.when(error_like(draft) | untranslated_gate(source, draft), "translation_suspect"),
        )
    )


def edit_guards(source: Column, previous: Column, candidate: Column, terms: dict[str, str]) -> Column:
    """Why an edit of a translation is turned down: validity, numbers, length against the text before, and terms it loses."""
    a, p, c = visible_text(source), visible_text(previous), visible_text(candidate)
    ratio = F.length(c) / F.greatest(F.length(p), F.lit(1))
    return F.array_compact(
        F.array(
            invalid_reason(source, candidate),
            F.when(number_tokens(a) != number_tokens(c), "number_mismatch"),
            F.when((ratio < 0.55) | (ratio > 1.8), "unsafe_length_change"),
            F.when(_lacking(terms, a, c, p), "glossary_term_removed"),
        )
    )


def undeliverable(failed: Column, total: Column, most: int = 20, share: float = 0.02) -> Column:
    """The delivery gate: more failures than ``most`` and more than that share."""
    return (failed > most) & (failed / total > share)


def sampled(c: Column, rate: float) -> Column:
    """Deterministic sample: the first 32 bits of SHA-1 as a share of their maximum."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate


def residual_category(c: Column, title_like: Column) -> Column:
    """What kind of untranslated rest a block of the finished text is."""
    w, latin, cjk = latin_words(c), latin_letters(c), cjk_chars(c)
    return (
        F.when(title_like & (w >= 2) & (latin >= 12) & (cjk == 0), "short_english_title")
        .when((w >= 10) & (latin >= 80) & (cjk == 0), "long_english_no_cjk")
        .when((w >= 12) & (latin >= 120) & (cjk < F.greatest(F.lit(6), F.floor(latin * 0.15))), "likely_untranslated")
        .when((cjk > 0) & (w >= 12) & (latin > F.greatest(F.lit(160.0), cjk * 2.5)), "mixed_latin_dominant")
        .otherwise("")
    )


def translation_error(message: Column) -> Column:
    """Error class of the translator; null without a message."""
    m = F.lower(message)
    return (
        F.when(m.isNull(), F.lit(None).cast("string"))
        .when(any_of(m, ("untranslated",)), "untranslated_response")
        .when(any_of(m, ("html tag mismatch",)), "html_mismatch")
        .when(any_of(m, ("json", "parse")), "invalid_json")
        .when(any_of(m, ("timeout", "timed out")), "timeout")
        .when(any_of(m, ("rate limit", "429")), "rate_limit")
        .when(any_of(m, ("authentication", "unauthorized", "api key")), "auth")
        .when(any_of(m, ("connect",)), "connection")
        .otherwise("model_error")
    )


def diagnosed_error(message: Column, flags: Column) -> Column:
    """Error class of the diagnostics report, where audit flags come first."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(has("likely_untranslated") | m.contains("untranslated"), "untranslated_response")
        .when(has("empty_translation") | m.contains("missing translation"), "empty_translation")
        .when(has("html_tag_mismatch"), "html_mismatch")
        .when(any_of(m, ("timeout", "timed out")), "timeout")
        .when(any_of(m, ("rate limit", "429")), "rate_limit")
        .when(any_of(m, ("json", "parse")), "invalid_json")
        .when(m.contains("connect"), "connection")
        .when(m != "", "model_error")
        .when(F.size(flags) > 0, "quality_audit")
        .otherwise("unknown")
    )


def archive_error_key(message: Column) -> Column:
    t = squeeze(F.coalesce(message, F.lit("")))
    low = F.lower(t)
    return (
        F.when(t == "", "unknown")
        .when(t.contains("html tag mismatch"), "html_tag_mismatch")
        .when(t.contains("untranslated response"), "untranslated_response")
        .when(any_of(low, ("json", "parse")), "json_parse")
        .when(low.contains("timeout"), "timeout")
        .otherwise(F.left(F.substring_index(t, ";", 1), F.lit(80)))
    )


def timing_error(message: Column, flags: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(has("likely_untranslated") | m.contains("untranslated"), "untranslated_response")
        .when(has("html_tag_mismatch") | has("html_mismatch") | any_of(m, ("html_tag_mismatch", "tag mismatch")), "html_tag_mismatch")
        .when(has("empty_translation"), "empty_translation")
        .when(any_of(m, ("json", "parse")), "json_parse")
        .when(any_of(m, ("timeout", "timed out")), "timeout")
        .when(any_of(m, ("rate limit", "429")), "rate_limit")
        .when(any_of(m, ("connection", "network")), "connection")
        .otherwise("other")
    )


def qa_report(failed: Column, untranslated: Column, audit_failed: Column, audit_warn: Column, residual: Column, scan_error: Column, same_title: Column, partial: Column, used: Column, most: int = -1) -> Column:
    """Struct of score, flags, status and retryable of a finished book."""
    penalty = lambda cond, c: F.when(cond, c).otherwise(0)
    off = (
        penalty(failed > 0, F.least(F.lit(80), 20 + failed * 2))
        + penalty(untranslated > 0, F.least(F.lit(60), 20 + untranslated * 3))
        + penalty(audit_failed > 0, F.least(F.lit(50), audit_failed * 2))
        + penalty(scan_error, F.lit(80))
        + penalty(residual > 0, F.least(F.lit(80), 25 + residual * 2))
        + penalty(same_title, F.lit(15))
    )
    flags = F.array_compact(
        F.array(
            F.when(failed > 0, "failed_chunks"),
            F.when(untranslated > 0, "likely_untranslated"),
            F.when(audit_failed > 0, "audit_failed_chunks"),
            F.when(scan_error, "artifact_scan_error"),
            F.when(residual > 0, "artifact_untranslated_blocks"),
            F.when(same_title, "title_untranslated"),
            F.when(partial, "partial_translation"),
        )
    )
    bad = F.size(flags) > 0
    return F.struct(
        F.greatest(F.lit(0), 100 - off).cast("int").alias("score"),
        flags.alias("flags"),
        F.when(bad, "failed").when(audit_warn > 0, "warning").otherwise("passed").alias("status"),
        (bad & ((F.lit(most) < 0) | (used < most))).alias("retryable"),
    )

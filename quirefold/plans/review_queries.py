"""Full rule sets of review, editing, acceptance, delivery and the cache, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import quality
from quirefold.operators import store
from quirefold.plans.base import CHUNKS, Registry, chunks
from quirefold.session import table

R = Registry()

#: Terms of the reviewed texts: words of the tables, with made-up translations.
TERMS = {"the": "这", "die": "那", "que": "何"}

# Fragments of all benchmark texts: what is translated, the draft, and an edit of the draft.
_FRAGMENTS = r"""b AS (SELECT item_id, text AS t, item_id % 7 AS k, item_id % 6 AS j, item_id % 5 AS m, repeat('译文内容', CAST(floor(length(text) / 8) AS INTEGER)) AS cjk FROM benchmark),
fragments AS (
  SELECT item_id,
    CASE k WHEN 0 THEN '<h2>' || t || '</h2>' WHEN 1 THEN t || '<sup>1</sup> -3,5' WHEN 2 THEN left(t, 60) WHEN 3 THEN '<p>' || t || ' 12 x7 (4)</p>' WHEN 4 THEN t || ' however <em>it</em> is' ELSE '<p>' || t || '</p>' END AS src,
    CASE j WHEN 0 THEN t WHEN 1 THEN '' WHEN 2 THEN cjk || '这 12 4' WHEN 3 THEN '短' WHEN 4 THEN 'Sorry, unable to process this.' ELSE cjk || '那何<em>的</em>' END AS dst,
    CASE m WHEN 0 THEN cjk || '<sup>1</sup> -3,5' WHEN 1 THEN cjk || cjk || cjk || '12 4' WHEN 2 THEN '' WHEN 3 THEN cjk || '<em>的</em>何' ELSE t END AS edit FROM b
), v AS (
  SELECT *, SRC_TEXT AS a, DST_TEXT AS d, EDIT_TEXT AS e FROM fragments
)"""


def _visible(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


FRAGMENTS = _FRAGMENTS.replace("SRC_TEXT", _visible("src")).replace("DST_TEXT", _visible("dst")).replace("EDIT_TEXT", _visible("edit"))


def _numbers(c: str) -> str:
    """Numbers that stand alone; separators are doubled so that two numbers need not share one."""
    return rf"regexp_extract_all(regexp_replace({c}, '([^A-Za-z0-9_.,:/+-])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9_])([+-]?\d+(?:[.,:/-]\d+)*)(?:$|[^A-Za-z0-9_])', 1)"


def _untranslated(a: str, b: str) -> str:
    words = lambda c: rf"len(regexp_extract_all({c}, '[A-Za-z][A-Za-z''\-]{{2,}}'))"
    letters, cjk = f"len(regexp_extract_all({b}, '[A-Za-z]'))", f"len(regexp_extract_all({b}, '[㐀-鿿]'))"
    flat = lambda c: rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
    kept = f"({words(b)} >= greatest(6, floor({words(a)} * 0.7)) AND {cjk} < greatest(6, floor({letters} * 0.15)))"
    drowned = f"({cjk} > 0 AND {words(b)} >= 12 AND {letters} > greatest(120.0, {cjk} * 2.5))"
    return f"({a} <> '' AND {b} <> '' AND {words(a)} >= 6 AND ({flat(a)} = {flat(b)} OR {kept} OR {drowned}))"


_ERROR = "regexp_matches(lower({}), 'error:|rate limit|cannot translate|can''t translate|unable to process|i''m unable|i am unable|sorry,')"
_INLINE = "list_sort(list_filter(regexp_extract_all(lower({}), '<([a-z][a-z0-9]*)', 1), lambda x: NOT regexp_full_match(x, 'p|div|h[1-6]|li|blockquote')))"


def _lacks(a: str, b: str, also: str | None = None) -> str:
    one = lambda s, d: rf"(regexp_matches({a}, '(?i)(^|[^\p{{L}}\p{{N}}_]){s}($|[^\p{{L}}\p{{N}}_])')" + (f" AND contains({also}, '{d}')" if also else "") + f" AND NOT contains({b}, '{d}'))"
    return "(" + " OR ".join(one(s, d) for s, d in TERMS.items()) + ")"


def _invalid(a: str, b: str) -> str:
    return f"CASE WHEN {b} = '' THEN 'empty' WHEN {_ERROR.format(b)} THEN 'error_response' WHEN {_untranslated(a, b)} THEN 'untranslated' WHEN {_INLINE.format(a)} <> {_INLINE.format(b)} THEN 'inline_tags' END"


def _fragments(spark, sf):
    b = table(spark, sf, "benchmark")
    t, k, j, m = F.col("text"), F.col("item_id") % 7, F.col("item_id") % 6, F.col("item_id") % 5
    cjk = F.repeat(F.lit("译文内容"), F.floor(F.length("text") / 8).cast("int"))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    src = F.when(k == 0, cat("<h2>", t, "</h2>")).when(k == 1, cat(t, "<sup>1</sup> -3,5")).when(k == 2, F.left(t, F.lit(60))).when(k == 3, cat("<p>", t, " 12 x7 (4)</p>")).when(k == 4, cat(t, " however <em>it</em> is")).otherwise(cat("<p>", t, "</p>"))
    dst = F.when(j == 0, t).when(j == 1, "").when(j == 2, cat(cjk, "这 12 4")).when(j == 3, "短").when(j == 4, "Sorry, unable to process this.").otherwise(cat(cjk, "那何<em>的</em>"))
    edit = F.when(m == 0, cat(cjk, "<sup>1</sup> -3,5")).when(m == 1, cat(cjk, cjk, cjk, "12 4")).when(m == 2, "").when(m == 3, cat(cjk, "<em>的</em>何")).otherwise(t)
    return b.select("item_id", src.alias("src"), dst.alias("dst"), edit.alias("edit"))


@R.add(
    "review_risks",
    rf"""WITH {FRAGMENTS} SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(src, '(?i)<h[1-6][\s>]') THEN 'heading' END,
  CASE WHEN regexp_matches(src, '(?i)<sup\b') THEN 'complex_html' END, CASE WHEN length(a) >= 420 THEN 'long_text' END, CASE WHEN {_numbers("a")} <> {_numbers("d")} THEN 'number_mismatch' END,
  CASE WHEN regexp_matches(lower(' ' || a || ' '), ' (not|never|unless|although|though|however|but|because|therefore|despite|rather than) ') THEN 'logic_relation' END,
  CASE WHEN length(d) / greatest(1, length(a)) < 0.32 OR length(d) / greatest(1, length(a)) > 2.4 THEN 'length_ratio' END, CASE WHEN {_lacks("a", "d")} THEN 'glossary_missing' END,
  CASE WHEN {_ERROR.format("dst")} OR {_untranslated("src", "dst")} THEN 'translation_suspect' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v""",
)
def review_risks(spark, sf):
    """all eight reasons for a second look."""
    return _fragments(spark, sf).select("item_id", F.array_join(quality.review_risks(F.col("src"), F.col("dst"), TERMS), ",").alias("reasons"))


@R.add("invalid_answers", f"WITH {FRAGMENTS} SELECT item_id, {_invalid('src', 'dst')} AS draft, {_invalid('src', 'edit')} AS edit FROM v")
def invalid_answers(spark, sf):
    """the first reason against the draft and against its edit."""
    return _fragments(spark, sf).select("item_id", quality.invalid_reason(F.col("src"), F.col("dst")).alias("draft"), quality.invalid_reason(F.col("src"), F.col("edit")).alias("edit"))


@R.add(
    "edit_guards",
    rf"""WITH {FRAGMENTS} SELECT item_id, array_to_string(list_filter([{_invalid("src", "edit")}, CASE WHEN {_numbers("a")} <> {_numbers("e")} THEN 'number_mismatch' END,
  CASE WHEN length(e) / greatest(1, length(d)) < 0.55 OR length(e) / greatest(1, length(d)) > 1.8 THEN 'unsafe_length_change' END,
  CASE WHEN {_lacks("a", "e", "d")} THEN 'glossary_term_removed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v""",
)
def edit_guards(spark, sf):
    """all four reasons against an edit."""
    return _fragments(spark, sf).select("item_id", F.array_join(quality.edit_guards(F.col("src"), F.col("dst"), F.col("edit"), TERMS), ",").alias("reasons"))


@R.add(
    "gate_reports",
    f"""WITH {CHUNKS}, g AS (SELECT strftime(done_at, '%Y-%m') AS month, count_if(status = 'failed') AS failed, count(*) AS total, arg_max(error_message, (sequence, job_id)) FILTER (error_message IS NOT NULL) AS last_error FROM chunks GROUP BY 1)
SELECT month, CAST(failed AS BIGINT) AS failed, total, NOT (failed > 20 AND failed / total > 0.02) AS deliverable, CASE WHEN failed > 20 AND failed / total > 0.02 THEN 'PARTIAL_TRANSLATION' END AS error_code,
  CASE WHEN failed > 20 AND failed / total > 0.02 THEN failed || '/' || total || ' failed, last: ' || coalesce(last_error, '') END AS message,
  CASE WHEN failed > 20 AND failed / total > 0.02 THEN CAST(100 - least(80, 20 + 2 * failed) AS INTEGER) END AS score FROM g""",
)
def gate_reports(spark, sf):
    """R3: each month's chunks under the delivery gate, with message, code and report of what is not delivered."""
    failed = F.col("status") == "failed"
    last = F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.struct("sequence", "job_id")))
    g = chunks(spark, sf).groupBy(F.date_format("done_at", "yyyy-MM").alias("month")).agg(F.count_if(failed).alias("failed"), F.count("*").alias("total"), last.alias("last_error"))
    bad, no, none = quality.undeliverable(F.col("failed"), F.col("total")), F.lit(False), F.lit(0)
    report = quality.qa_report(F.col("failed"), none, none, none, none, no, no, F.lit(True), none)
    message = F.concat(F.col("failed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" failed, last: "), F.coalesce("last_error", F.lit("")))
    return g.select("month", "failed", "total", (~bad).alias("deliverable"), F.when(bad, "PARTIAL_TRANSLATION").alias("error_code"), F.when(bad, message).alias("message"), F.when(bad, report["score"]).alias("score"))


@R.add(
    "cache_lookups",
    f"""WITH {CHUNKS}, q AS (
  SELECT job_id, sequence, sequence % 97 AS source, chapter_id AS family, CAST(retry_count AS BIGINT) AS context, CASE job_id % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'verified' WHEN 2 THEN 'reuse' ELSE 'odd' END AS policy, CAST(job_id % 3 AS BIGINT) AS attempt FROM chunks
), c AS (
  SELECT source, family, context, job_id * 100 + sequence % 100 AS made, CASE WHEN job_id % 7 = 0 THEN '' ELSE job_id || '-' || sequence END AS value FROM q WHERE job_id % 11 = 0
), e AS (
  SELECT source, family, context, arg_max(value, (made, value)) AS exact FROM c WHERE value <> '' GROUP BY ALL
), f AS (
  SELECT source, family, arg_max(value, (made, value)) AS compatible FROM c WHERE value <> '' GROUP BY ALL
), h AS (
  SELECT q.job_id, q.sequence, exact, compatible, CASE WHEN policy = 'fresh' THEN 'miss' WHEN exact IS NOT NULL THEN 'exact' WHEN policy <> 'verified' AND attempt <= 1 AND compatible IS NOT NULL THEN 'compatible' ELSE 'miss' END AS hit
  FROM q LEFT JOIN e USING (source, family, context) LEFT JOIN f USING (source, family)
)
SELECT job_id, sequence, hit, CASE hit WHEN 'exact' THEN exact WHEN 'compatible' THEN compatible END AS value FROM h""",
)
def cache_lookups(spark, sf):
    """R4: look-ups of all chunks by policy, attempt, family and context."""
    c = chunks(spark, sf)
    policy = F.element_at(F.array(*map(F.lit, ("fresh", "verified", "reuse", "odd"))), (F.col("job_id") % 4).cast("int") + 1)
    q = c.select("job_id", "sequence", (F.col("sequence") % 97).alias("source"), F.col("chapter_id").alias("family"), F.col("retry_count").alias("context"), policy.alias("policy"), (F.col("job_id") % 3).alias("attempt"))
    value = F.when(F.col("job_id") % 7 == 0, "").otherwise(F.concat(F.col("job_id").cast("string"), F.lit("-"), F.col("sequence").cast("string")))
    kept = q.where("job_id % 11 = 0").select("source", "family", "context", F.struct((F.col("job_id") * 100 + F.col("sequence") % 100).alias("made"), value.alias("v")).alias("made"), value.alias("value"))
    return store.cache_lookup(q, kept, "source", "family", "context", "made", "value").select("job_id", "sequence", "hit", "value")

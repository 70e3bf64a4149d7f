"""Queries whose inner step is a document parse or an ordered match."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import lexicon, phrases
from quirefold.plans.base import Registry
from quirefold.session import table
from quirefold.sources.html import chunk_html

R = Registry()


@R.add("chunk_html")
def chunk_pages(spark, sf):
    """Leaf blocks of all pages with locators."""
    return chunk_html(table(spark, sf, "pages"), "page_id", "html")


@R.add("chunk_html_counts")
def chunk_html_counts(spark, sf):
    c = chunk_html(table(spark, sf, "pages"), "page_id", "html")
    return c.groupBy("page_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), F.sum("word_count").alias("words"))


#: A small dictionary over the words of the tables.
TERMS = {"the": "THE", "and": "AND", "of": "OF", "der": "DER"}


@R.add(
    "lexicon_hits",
    r"""WITH w AS (SELECT unnest(string_split_regex(text, 'the|and|of|der')) AS gap, doc_id FROM documents)
SELECT doc_id, count(*) - 1 AS hits FROM w GROUP BY doc_id HAVING count(*) > 1""",
)
def lexicon_hits(spark, sf):
    """Dictionary hits by document, leftmost and longest."""
    matched = lexicon.replace_terms(TERMS).asNondeterministic()  # else the filter runs it a second time
    d = table(spark, sf, "documents").select("doc_id", matched("text").alias("r"))
    return d.select("doc_id", F.size("r.hits").cast("long").alias("hits")).where("hits > 0")


@R.add(
    "lexicon_replaced",
    r"""WITH w AS (SELECT item_id, string_split_regex(text, 'the|and|of|der') AS gaps, regexp_extract_all(text, 'the|and|of|der') AS hits FROM benchmark)
SELECT item_id, sha256(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(upper(hits[i]), '')), '')) AS digest FROM w""",
)
def lexicon_replaced(spark, sf):
    """Replaced texts of the whole benchmark."""
    return table(spark, sf, "benchmark").select("item_id", F.sha2(lexicon.replace_terms(TERMS)("text")["text"], 256).alias("digest"))


@R.add(
    "lexicon_replaced_all",
    r"""WITH w AS (SELECT doc_id, string_split_regex(text, 'the|and|of|der') AS gaps, regexp_extract_all(text, 'the|and|of|der') AS hits FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(upper(hits[i]), '')), '')) AS digest FROM w""",
)
def lexicon_replaced_all(spark, sf):
    """Replaced texts of every document, in all languages and with overlapping terms."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(lexicon.replace_terms(TERMS, hits=False)("text")["text"], 256).alias("digest"))


@R.add(
    "relevant_terms",
    r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS x FROM benchmark), h AS (SELECT item_id, lower(x[i]) AS term, i FROM w, unnest(range(1, len(x) + 1)) AS u(i)),
t AS (SELECT item_id, term, i, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, i) AS k FROM h WHERE term IN ('the', 'that', 'of')),
f AS (SELECT item_id, term, min(i) AS i FROM t WHERE k <= 32 GROUP BY ALL)
SELECT item_id, coalesce(string_agg(term, ',' ORDER BY i), '') AS terms FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id""",
)
def relevant_terms(spark, sf):
    spans = lexicon.relevant_terms(F.col("text"), {"the": "x", "that": "y", "of": "z"})
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_distinct(F.transform(spans, lambda s: s["term"])), ",").alias("terms"))


_BENCH_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_HITS = rf"""t AS (
  SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT {_BENCH_WORDS} AS w FROM benchmark), unnest(range(2, 9)) AS l(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS s(i) WHERE i + n - 1 <= len(w)
), g AS (
  SELECT doc_id, i - 1 AS start, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), unnest(range(2, 9)) AS l(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS s(i) WHERE i + n - 1 <= len(w)
), h AS (
  SELECT doc_id, start, n, term FROM g JOIN t USING (n, term)
)"""


def _phrases(spark, sf):
    """All different runs of two to eight words of the benchmark's texts."""
    w = table(spark, sf, "benchmark").select(phrases.words(F.col("text")).alias("w"))

    def runs(n: int):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    return w.select(F.explode(F.concat(*[runs(n) for n in range(2, 9)])).alias("term")).distinct()


@R.add("phrase_counts", f"WITH {_HITS} SELECT doc_id, count(*) AS hits, count(DISTINCT term) AS terms, CAST(max(n) AS INTEGER) AS longest FROM h GROUP BY doc_id")
def phrase_counts(spark, sf):
    """How often, and how many different, phrases of the benchmark occur in each document."""
    h = phrases.hits(table(spark, sf, "documents"), _phrases(spark, sf), "doc_id", "text")
    return h.groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_distinct("term").alias("terms"), F.max("length").alias("longest"))


@R.add(
    "phrase_spans",
    f"""WITH RECURSIVE {_HITS}, b AS (
  SELECT doc_id, start, max(n) AS n, arg_max(term, n) AS term FROM h GROUP BY doc_id, start
), f AS (
  SELECT b.doc_id, b.start, b.n, b.term, (SELECT min(c.start) FROM b AS c WHERE c.doc_id = b.doc_id AND c.start >= b.start + b.n) AS next FROM b
), r AS (
  SELECT f.* FROM f JOIN (SELECT doc_id, min(start) AS start FROM b GROUP BY doc_id) USING (doc_id, start)
  UNION ALL SELECT f.* FROM r JOIN f ON f.doc_id = r.doc_id AND f.start = r.next
)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS length, term FROM r""",
)
def phrase_spans(spark, sf):
    """The phrases of the benchmark in every document, leftmost and longest, without overlap."""
    return phrases.leftmost_longest(phrases.hits(table(spark, sf, "documents"), _phrases(spark, sf), "doc_id", "text"), "doc_id")

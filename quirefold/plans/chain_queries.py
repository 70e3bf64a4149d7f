"""The chain of cleaners over all pages and their style sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import markup
from quirefold.operators import chain
from quirefold.operators.chain import Stage
from quirefold.plans.base import Registry
from quirefold.session import table

R = Registry()

PAGE, SHEET = 9, 2


def whole_paragraphs(html: str) -> tuple[str, dict[str, int]]:
    """Drops empty paragraphs; raises on a page whose paragraphs are not all closed."""
    opened, closed = html.count("<p>"), html.count("</p>")
    if opened != closed:
        raise ValueError(f"{opened} paragraphs opened, {closed} closed")
    return html.replace("<p></p>", ""), {"paragraphs": opened}


STAGES = [
    Stage("repair", markup.repaired, kinds=(PAGE,)),
    Stage("entities", lambda c: F.replace(c, F.lit("&middot;"), F.lit("·")), kinds=(PAGE,)),
    Stage("paragraphs", function=whole_paragraphs, kinds=(PAGE,)),
    Stage("emphasis", lambda c: F.replace(F.replace(c, F.lit("<b>"), F.lit("<strong>")), F.lit("</b>"), F.lit("</strong>")), kinds=(PAGE,)),
    Stage("margins", lambda c: F.regexp_replace(c, r"margin:0(?=[;}])", "margin:1em 0")),
]


def cleaned(spark, sf):
    p = table(spark, sf, "pages")
    sheets = p.select("page_id", F.lit(SHEET).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit("(?s)<style>(.*?)</style>"), F.lit(1))).alias("content"))
    return chain.run(p.select("page_id", F.lit(PAGE).alias("kind"), F.col("html").alias("content")).unionByName(sheets), STAGES, kind="kind")


_CLEANED = r"""d AS (
  SELECT page_id, 9 AS kind, html AS c0 FROM pages UNION ALL SELECT page_id, 2, unnest(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1)) FROM pages
), s1 AS (
  SELECT *, CASE WHEN kind = 9 THEN regexp_replace(regexp_replace(c0, '(?is)<!DOCTYPE\s+html\s+(?:PUBLIC|SYSTEM)[^>]*>', '<!DOCTYPE html>'), '\s+xmlns=""', '', 'g') ELSE c0 END AS c1 FROM d
), s2 AS (
  SELECT *, CASE WHEN kind = 9 THEN replace(c1, '&middot;', chr(183)) ELSE c1 END AS c2 FROM s1
), s3 AS (
  SELECT *, length(c2) - length(replace(c2, '<p>', '..')) AS n, kind = 9 AND length(c2) - length(replace(c2, '<p>', '..')) <> length(c2) - length(replace(c2, '</p>', '...')) AS failed FROM s2
), s4 AS (
  SELECT *, CASE WHEN kind = 9 AND NOT failed THEN replace(c2, '<p></p>', '') ELSE c2 END AS c3 FROM s3
), s5 AS (
  SELECT *, CASE WHEN kind = 9 THEN replace(replace(c3, '<b>', '<strong>'), '</b>', '</strong>') ELSE c3 END AS c4 FROM s4
), s6 AS (
  SELECT *, replace(replace(c4, 'margin:0;', 'margin:1em 0;'), 'margin:0}', 'margin:1em 0}') AS c5 FROM s5
)"""


@R.add("cleaned_pages", f"WITH {_CLEANED} SELECT page_id, kind, sha256(c5) AS sha256, failed FROM s6")
def cleaned_pages(spark, sf):
    """Every document after all stages, and whether a stage failed on it."""
    return cleaned(spark, sf).select("page_id", "kind", F.sha2("content", 256).alias("sha256"), F.exists("trail", lambda s: s["status"] == "failed").alias("failed"))


@R.add(
    "cleaner_report",
    f"""WITH {_CLEANED}, l AS (
  SELECT unnest([
    {{'position': 0, 'stage': 'repair', 'a': c0, 'b': c1, 'failed': FALSE, 'skipped': kind = 2}}, {{'position': 1, 'stage': 'entities', 'a': c1, 'b': c2, 'failed': FALSE, 'skipped': kind = 2}},
    {{'position': 2, 'stage': 'paragraphs', 'a': c2, 'b': c3, 'failed': failed, 'skipped': kind = 2}}, {{'position': 3, 'stage': 'emphasis', 'a': c3, 'b': c4, 'failed': FALSE, 'skipped': kind = 2}},
    {{'position': 4, 'stage': 'margins', 'a': c4, 'b': c5, 'failed': FALSE, 'skipped': FALSE}}]) AS s FROM s6)
SELECT CAST(s.position AS INTEGER) AS position, s.stage AS stage, count(*) AS rows, count(*) FILTER (s.a <> s.b) AS changed, count(*) FILTER (s.failed) AS failed, count(*) FILTER (s.skipped OR s.a IS NULL) AS skipped,
  CAST(0 AS BIGINT) AS empty, CAST(sum(length(s.a)) AS BIGINT) AS chars_in, CAST(sum(length(s.b)) AS BIGINT) AS chars_out FROM l GROUP BY ALL""",
)
def cleaner_report(spark, sf):
    """Each stage's rows: in, changed, failed and skipped, with characters before and after."""
    return chain.report(cleaned(spark, sf)).drop("ms")


@R.add("cleaner_counts", f"WITH {_CLEANED} SELECT 'paragraphs' AS stage, 'paragraphs' AS name, CAST(sum(n) AS BIGINT) AS n FROM s6 WHERE kind = 9 AND NOT failed")
def cleaner_counts(spark, sf):
    return chain.counts(cleaned(spark, sf))

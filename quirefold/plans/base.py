"""How plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, big: str = ""):
        """big: columns that the SQL's engine counts in a wider type than BIGINT."""

        def register(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in big.split())
                self.oracle[name] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if big else sql
            return f

        return register


#: A page's title in plain letters, and its SQL.
TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[^A-Za-z ]', '', 'g'))"


def plain_title() -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), "[^A-Za-z ]", ""))


def forms(spark: SparkSession, sf: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every page in one of some text forms that the tables lack, with the page's title for {t} and its number for {n}."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), plain_title().alias("t"))
    at = (F.col("id") % len(rows)).cast("int") + 1
    out = [F.col("id")]
    for k, (name, kind) in enumerate((c.split(" ", 1) for c in schema.split(", ")[1:]), 1):
        value = F.get(F.array(*[F.array(*map(F.lit, r[k])) if isinstance(r[k], list) else F.lit(r[k]) for r in rows]).cast(f"array<{kind}>"), at - 1)
        if kind == "string":
            value = F.replace(F.replace(value, F.lit("{t}"), F.col("t")), F.lit("{n}"), F.col("id").cast("string"))
        out.append(value.alias(name))
    return p.select(*out)


def forms_sql(rows: list[tuple], names: str) -> str:
    """The same as an SQL table."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    cols = ["page_id AS id"]
    for k, name in enumerate(names.split(", ")[1:], 1):
        value = "[" + ", ".join(one(r[k]) for r in rows) + f"][CAST(page_id % {len(rows)} AS INTEGER) + 1]"
        if all(r[k] is None or isinstance(r[k], str) for r in rows):
            value = f"replace(replace({value}, '{{t}}', title), '{{n}}', CAST(page_id AS VARCHAR))"
        cols.append(f"{value} AS {name}")
    return f"(SELECT {', '.join(cols)} FROM (SELECT page_id, {TITLE} AS title FROM pages)) AS t"


# Bridges from the driver's tables to the shapes of a translation service.

LINES = r"""lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
  FROM documents)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines, numbered in the row: no shuffle."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


PAIRS = r"""pairs AS (
  SELECT item_id, text AS src, CASE item_id % 5
      WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[0-9]', '', 'g')
      WHEN 3 THEN left(text, CAST(floor(length(text) / 10) AS BIGINT)) ELSE 'Sorry, unable to process this.' END AS dst
  FROM benchmark)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Source and 'translation', the latter spoiled in a way that the id tells."""
    b, k = table(spark, sf, "benchmark"), F.col("item_id") % 5
    dst = (
        F.when(k == 0, F.col("text"))
        .when(k == 1, "")
        .when(k == 2, F.regexp_replace("text", "[0-9]", ""))
        .when(k == 3, F.left("text", F.floor(F.length("text") / 10).cast("int")))
        .otherwise("Sorry, unable to process this.")
    )
    return b.select("item_id", F.col("text").alias("src"), dst.alias("dst"))


CHUNKS = r"""chunks AS (
  SELECT l_orderkey AS job_id, l_partkey % 3 AS chapter_id, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000000 + l_suppkey AS sequence,
    CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'cached' ELSE 'translated' END AS status,
    CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS latency_ms,
    CAST(l_quantity AS BIGINT) % 4 AS retry_count,
    CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS BIGINT) * 10 END AS prompt_tokens,
    CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS BIGINT) * 4 END AS completion_tokens,
    CASE WHEN l_returnflag <> 'R' THEN NULL ELSE CASE l_partkey % 6 WHEN 0 THEN 'html tag mismatch; retry still invalid'
      WHEN 1 THEN 'request timed out' WHEN 2 THEN 'HTTP 429 rate limit' WHEN 3 THEN 'Invalid API key'
      WHEN 4 THEN 'JSON parse failed' ELSE 'connection reset' END END AS error_message,
    list_filter([CASE WHEN l_suppkey % 7 = 0 THEN 'likely_untranslated' END, CASE WHEN l_suppkey % 5 = 0 THEN 'glossary_review' END,
      CASE WHEN l_returnflag = 'R' AND l_partkey % 6 = 0 THEN 'html_tag_mismatch' END], lambda f: f IS NOT NULL) AS flags,
    l_shipdate AS done_at
  FROM lineitem)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Translation chunks of jobs, from the order lines."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey") % 6
    qty = F.col("l_quantity").cast("long")
    live = lambda c: F.when(flag == "A", F.lit(0).cast("long")).otherwise(c)
    error = F.when(
        flag == "R",
        F.when(part == 0, "html tag mismatch; retry still invalid")
        .when(part == 1, "request timed out")
        .when(part == 2, "HTTP 429 rate limit")
        .when(part == 3, "Invalid API key")
        .when(part == 4, "JSON parse failed")
        .otherwise("connection reset"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("l_suppkey") % 7 == 0, "likely_untranslated"),
            F.when(F.col("l_suppkey") % 5 == 0, "glossary_review"),
            F.when((flag == "R") & (part == 0), "html_tag_mismatch"),
        )
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_partkey") % 3).alias("chapter_id"),
        ((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 1000000 + F.col("l_suppkey")).alias("sequence"),
        F.when(flag == "R", "failed").when(flag == "A", "cached").otherwise("translated").alias("status"),
        live(F.floor("l_extendedprice")).alias("latency_ms"),
        (qty % 4).alias("retry_count"),
        live(qty * 10).alias("prompt_tokens"),
        live(qty * 4).alias("completion_tokens"),
        error.alias("error_message"),
        flags.alias("flags"),
        F.col("l_shipdate").alias("done_at"),
    )


JOBS = r"""jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey // 4 AS batch_id, o_orderkey % 4 AS batch_index,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'PARTIAL_TRANSLATION' ELSE 'TIMEOUT' END END AS error_code,
    o_orderdate AS created_at, o_totalprice AS amount
  FROM orders)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs in batches of up to four, from the orders."""
    s, k = F.col("o_orderstatus"), F.col("o_custkey") % 3
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.expr("o_orderkey div 4").alias("batch_id"),
        (F.col("o_orderkey") % 4).alias("batch_index"),
        F.when(s == "F", "failed").when(s == "O", "success").otherwise("running").alias("status"),
        F.when(s == "F", F.when(k == 1, "PARTIAL_TRANSLATION").when(k == 2, "TIMEOUT")).alias("error_code"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("amount"),
    )

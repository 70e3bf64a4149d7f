"""Queries on markup, names and job rules; forms that the tables lack are set around each page's title or number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import markup
from quirefold.operators import ordered
from quirefold.plans.base import CHUNKS, JOBS, Registry, chunks, forms, forms_sql, jobs
from quirefold.session import table

R = Registry()

_TABLES = [(1, "<p>{t}</p><table><tr/>{n}</table>{t}<TABLE>x</TABLE>"), (2, '<div class="epub-table-wrap"><table>{t}</table></div>'), (3, "{t}")]


@R.add("wrapped_tables", rf"""SELECT id, CASE WHEN contains(html, 'epub-table-wrap') THEN html ELSE regexp_replace(html, '(?is)(<table\b[^>]*>.*?</table>)', '<div class="epub-table-wrap">\1</div>', 'g') END AS html FROM {forms_sql(_TABLES, "id, html")}""")
def wrapped_tables(spark, sf):
    return forms(spark, sf, _TABLES, "id int, html string").select("id", markup.wrap_tables(F.col("html")).alias("html"))


_MATH = [(1, "<math><mi>{t}</mi></math>"), (2, '<math display="block"/>{t}'), (3, '<svg width="{n}"><g/></svg>')]


@R.add(
    "protected_formulas",
    rf"""SELECT id, CASE WHEN contains(html, 'display=') THEN html ELSE regexp_replace(regexp_replace(html, '(<math\b[^>]*?)\s*/?>', '\1 display="inline">', 'g'), '(<svg\b[^>]*?)\s*/?>', '\1 overflow="visible">', 'g') END AS html FROM {forms_sql(_MATH, "id, html")}""",
)
def protected_formulas(spark, sf):
    h = markup.with_attribute(markup.with_attribute(F.col("html"), "math", "display", "inline"), "svg", "overflow", "visible")
    return forms(spark, sf, _MATH, "id int, html string").select("id", h.alias("html"))


_CSS = [(1, "a{color: red; border: 0.5px solid; hyphens: auto} /* {t} */"), (2, "b{background-color: #eee; opacity: .{n}; color: black;}"), (3, "c{border-top: {n}.7px}\nhyphens: auto\n  column-gap: {n}em")]


@R.add("device_css")
def device_css(spark, sf):
    d = forms(spark, sf, _CSS, "id int, css string")
    return d.select("id", markup.kindle_css(F.col("css")).alias("kindle"), markup.apple_css(F.col("css")).alias("apple"))


_DOC = [(1, '<?xml version="1.0"?><!DOCTYPE html PUBLIC "x" "y"><html xmlns=""><p/>{t}</html>'), (2, "<!DOCTYPE html><p/>{t}")]


@R.add(
    "repaired_documents",
    f"""SELECT id, regexp_replace(regexp_replace(html, '(?is)<!DOCTYPE\\s+html\\s+(?:PUBLIC|SYSTEM)[^>]*>', '<!DOCTYPE html>'), '\\s+xmlns=""', '', 'g') AS html FROM {forms_sql(_DOC, "id, html")}""",
)
def repaired_documents(spark, sf):
    return forms(spark, sf, _DOC, "id int, html string").select("id", markup.repaired(F.col("html")).alias("html"))


@R.add(
    "repaired_pages",
    """SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!DOCTYPE\\s+html\\s+(?:PUBLIC|SYSTEM)[^>]*>', '<!DOCTYPE html>'), '\\s+xmlns=""', '', 'g') AS html FROM pages""",
)
def repaired_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.repaired(F.col("html")).alias("html"))


_PACK = [(1, ["mimetype", "a"], False, 0, 0), (2, ["a", "mimetype"], True, 2, 1), (3, ["a"], False, 0, 0), (4, ["mimetype"], True, 0, 3)]


@R.add(
    "package_issues",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN names[1] <> 'mimetype' THEN 'PKG-006' END, CASE WHEN list_contains(names, 'mimetype') AND z THEN 'PKG-006' END, CASE WHEN d > 0 THEN 'HTM-004' END, CASE WHEN n > 0 THEN 'RSC-005' END], lambda x: x IS NOT NULL), ',') AS issues
FROM {forms_sql(_PACK, "id, names, z, d, n")}""",
)
def package_issues(spark, sf):
    d = forms(spark, sf, _PACK, "id int, names array<string>, z boolean, d int, n int")
    return d.select("id", F.array_join(markup.issues(*(F.col(c) for c in ("names", "z", "d", "n"))), ",").alias("issues"))


@R.add(
    "tag_round_trip",
    r"""SELECT page_id, sha256(html) AS restored, len(regexp_extract_all(html, '(?i)</?[a-z][^>]*>')) - len(regexp_extract_all(html, '(?i)</?(?:p|div|h[1-6]|li|blockquote)\b[^>]*>')) AS tags FROM pages""",
)
def tag_round_trip(spark, sf):
    """All pages with numbered tags restored, and how many tags were numbered."""
    p = table(spark, sf, "pages").withColumn("p", markup.protected(F.col("html")))
    return p.select("page_id", F.sha2(markup.restored(F.col("p.text"), F.col("p.tags")), 256).alias("restored"), F.size("p.tags").cast("long").alias("tags"))


@R.add(
    "singleton_fragments",
    r"""SELECT page_id FROM pages WHERE len(regexp_extract_all(html, '(?i)<sup\b')) > 0 OR len(regexp_extract_all(html, '(?i)<a\b')) >= 2
  OR len(regexp_extract_all(html, '(?i)<[a-z]')) - len(regexp_extract_all(html, '(?i)<(?:p|div|h[1-6]|li|blockquote)\b')) >= 4""",
)
def singleton_fragments(spark, sf):
    return table(spark, sf, "pages").where(markup.singleton(F.col("html"))).select("page_id")


@R.add("lenient_json", "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def lenient_json(spark, sf):
    """The objects of all events' properties as a model might answer: fenced, with talk around, a trailing comma, or without JSON."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 5
    broken = F.regexp_replace("props", r"\}$", ",}")
    said = F.when(k == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure! "), "props", F.lit(" done"))).when(k == 2, F.concat(F.lit(" \n"), broken)).when(k == 3, F.col("props")).otherwise("no json")
    return e.select("event_id", F.from_json(markup.lenient_json(said), "k int")["k"].alias("k"))


_SPACE = [(1, "  {t} ", "b{n}"), (2, "\n", ""), (3, "{t}", " y {n} ")]


@R.add("kept_space", rf"""SELECT id, CASE WHEN trim(b) = '' THEN a ELSE regexp_extract(a, '^\s*') || trim(b) || regexp_extract(a, '\s*$') END AS t FROM {forms_sql(_SPACE, "id, a, b")}""")
def kept_space(spark, sf):
    return forms(spark, sf, _SPACE, "id int, a string, b string").select("id", markup.keeps_space(F.col("a"), F.col("b")).alias("t"))


@R.add("chapter_ids", r"""SELECT page_id, CASE WHEN s = '' THEN 'chapter' ELSE s END AS chapter_id FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[^\p{L}\p{N}_]', '_', 'g') AS s FROM pages)""")
def chapter_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.chapter_id(F.col("url")).alias("chapter_id"))


@R.add("output_suffixes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '繁体' ELSE '简体' END || CASE WHEN p_size % 3 = 0 THEN '_翻译_en' || CASE WHEN p_size % 5 = 0 THEN '_双语' ELSE '' END ELSE '' END AS suffix FROM part")
def output_suffixes(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", markup.output_suffix(s % 2 == 0, s % 3 == 0, F.lit("en"), s % 5 == 0).alias("suffix"))


_PHONE = r"\+?[0-9]{7,13}"


@R.add("phones", f"WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS p FROM documents) SELECT doc_id, p AS found, CASE WHEN starts_with(p, '+') THEN p WHEN starts_with(p, '86') AND length(p) = 13 THEN '+' || p ELSE '+86' || p END AS phone FROM d")
def phones(spark, sf):
    """Numbers met in all documents in international form."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_PHONE})"), F.lit(1))).alias("found"))
    return d.select("doc_id", "found", markup.e164(F.col("found")).alias("phone"))


@R.add("cropped_documents", "SELECT doc_id, CASE WHEN n <= 3 AND long THEN text ELSE '' END AS text FROM (SELECT doc_id, text, length(text) > 500 AS long, count_if(length(text) > 500) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS n FROM documents)")
def cropped_documents(spark, sf):
    """The first three long documents of a book stay; the rest are blank.  Only ids are ranked."""
    d = table(spark, sf, "documents")
    n = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    kept = d.where(F.length("text") > 500).select("lang", "source", "doc_id").withColumn("n", n).where("n <= 3").select("doc_id", F.lit(True).alias("kept"))
    return d.select("doc_id", "text").join(kept, "doc_id", "left").select("doc_id", F.when(F.col("kept"), F.col("text")).otherwise("").alias("text"))


@R.add("job_fields", f"WITH {JOBS} SELECT job_id, printf('%d.%d s', CAST(floor(amount) AS BIGINT) // 1000, CAST(floor(amount) AS BIGINT) // 100 % 10) AS duration, CASE status WHEN 'success' THEN 'Done' WHEN 'failed' THEN 'Failed' ELSE 'Running' END AS label FROM jobs")
def job_fields(spark, sf):
    """Labels and durations as the page shows them."""
    labels = F.create_map(*[F.lit(x) for x in ("success", "Done", "failed", "Failed", "running", "Running")])
    return jobs(spark, sf).select("job_id", F.format_string("%d.%d s", F.expr("floor(amount) div 1000"), F.expr("floor(amount) div 100 % 10")).alias("duration"), labels[F.col("status")].alias("label"))


@R.add("cache_namespaces", "SELECT c_custkey, array_to_string(list_filter(['zh', 'v2', CASE WHEN c_nationkey % 2 = 0 THEN 'high' ELSE 'standard' END, c_mktsegment, printf('t%.2f', c_nationkey / 100.0), CASE WHEN c_acctbal < 0 THEN 'debt' END], lambda x: x IS NOT NULL), '@') AS key FROM customer")
def cache_namespaces(spark, sf):
    k = F.col("c_nationkey")
    key = F.concat_ws("@", F.lit("zh"), F.lit("v2"), F.when(k % 2 == 0, "high").otherwise("standard"), "c_mktsegment", F.format_string("t%.2f", k / 100.0), F.when(F.col("c_acctbal") < 0, "debt"))
    return table(spark, sf, "customer").select("c_custkey", key.alias("key"))


@R.add("model_rules", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'blocked' WHEN lower(p_type) LIKE '%steel%' THEN 'allowed' ELSE 'default' END AS verdict FROM part")
def model_rules(spark, sf):
    """Allow and block lists on names; the block list wins."""
    low = F.lower("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(low.rlike("brass"), "blocked").when(low.rlike("steel"), "allowed").otherwise("default").alias("verdict"))


@R.add("valid_files", "SELECT page_id, regexp_matches(lower(url), '\\.(epub|pdf|mobi|azw3|docx|md|markdown)$') AS valid FROM pages")
def valid_files(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower("url").rlike(r"\.(epub|pdf|mobi|azw3|docx|md|markdown)$").alias("valid"))


@R.add("job_access", f"WITH {JOBS} SELECT job_id, user_id % 2 = 0 OR created_at >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS allowed FROM jobs")
def job_access(spark, sf):
    return jobs(spark, sf).select("job_id", ((F.col("user_id") % 2 == 0) | (F.col("created_at") >= F.lit("1998-01-01").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))).alias("allowed"))


_RISK = ["trash", "stupid", "loser"]


@R.add("risky_documents", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{'|'.join(_RISK)}')")
def risky_documents(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("|".join(sorted(_RISK, key=len, reverse=True)))).select("doc_id")


@R.add(
    "polish_budget",
    f"WITH r AS (SELECT lang, doc_id, length(text) // 2 AS tokens FROM documents WHERE regexp_matches(text, '{'|'.join(_RISK)}')), s AS (SELECT *, sum(tokens) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT lang, doc_id, CAST(used AS BIGINT) AS used FROM s WHERE used - tokens < 20000",
)
def polish_budget(spark, sf):
    """Risky texts are polished in order until the token budget is spent."""
    r = table(spark, sf, "documents").where(F.col("text").rlike("|".join(_RISK))).select("lang", "doc_id", F.expr("length(text) div 2").alias("tokens"))
    return ordered.running_sum(r, ["lang"], "doc_id", "tokens", "used").where("used - tokens < 20000").select("lang", "doc_id", "used")


@R.add("title_matches", "WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages) SELECT title, min(page_id) AS page_id FROM h WHERE title <> '' GROUP BY title")
def title_matches(spark, sf):
    """Each title's first page."""
    t = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title")).where("title <> ''")
    return t.groupBy("title").agg(F.min("page_id").alias("page_id"))


@R.add("toc_headings", r"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(h[1-6])[^>]*>', 1)) AS tag FROM pages) SELECT page_id, CAST(right(tag, 1) AS INTEGER) AS level, count(*) AS n FROM h GROUP BY ALL")
def toc_headings(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<(h[1-6])[^>]*>"), F.lit(1))).alias("tag"))
    return h.groupBy("page_id", F.right("tag", F.lit(1)).cast("int").alias("level")).agg(F.count("*").alias("n"))


@R.add("anchor_numbers", "SELECT page_id, 'toc_anchor_' || (count_if(page_id % 3 = 0) OVER (PARTITION BY page_id % 7 ORDER BY page_id ROWS UNBOUNDED PRECEDING) - 1) AS anchor FROM pages QUALIFY page_id % 3 = 0")
def anchor_numbers(spark, sf):
    """Headings without an id get running anchors within their book."""
    w = Window.partitionBy(F.col("page_id") % 7).orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    p = table(spark, sf, "pages").withColumn("n", F.count_if(F.col("page_id") % 3 == 0).over(w) - 1)
    return p.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("toc_anchor_"), F.col("n").cast("string")).alias("anchor"))


@R.add("tail_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 300")
def tail_events(spark, sf):
    """The newest 300 events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 300").select("user_id", "event_id")


@R.add("recent_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def recent_days(spark, sf):
    """Retention: rows of the last seven days before the newest."""
    e = table(spark, sf, "events")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("since")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))  # one row


@R.add("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Tumbling hours (an extension)."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@R.add(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS id FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, id""",
)
def event_sessions(spark, sf):
    """Sessions with a gap of six hours (an extension)."""
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@R.add("audit_examples", f"WITH {CHUNKS}, r AS (SELECT chapter_id, job_id, sequence, row_number() OVER (PARTITION BY chapter_id ORDER BY job_id, sequence) AS n FROM chunks WHERE len(flags) > 0) SELECT chapter_id, job_id, sequence FROM r WHERE n <= 20")
def audit_examples(spark, sf):
    """The first 20 flagged chunks of each chapter."""
    w = Window.partitionBy("chapter_id").orderBy("job_id", "sequence")
    return chunks(spark, sf).where(F.size("flags") > 0).withColumn("n", F.row_number().over(w)).where("n <= 20").select("chapter_id", "job_id", "sequence")


@R.add("final_stats", f"WITH {CHUNKS} SELECT job_id, count(*) - count_if(status = 'failed') - count_if(status = 'cached') AS translated, CAST(sum(retry_count) AS BIGINT) AS retries FROM chunks GROUP BY job_id", big="translated")
def final_stats(spark, sf):
    off = F.count_if(F.col("status") == "failed") + F.count_if(F.col("status") == "cached")
    return chunks(spark, sf).groupBy("job_id").agg((F.count("*") - off).alias("translated"), F.sum("retry_count").alias("retries"))


@R.add("archive_analysis", f"WITH {CHUNKS} SELECT error_message, count(*) AS n, round_even(avg(retry_count), 4) AS avg_retries, max(latency_ms) AS worst FROM chunks WHERE status = 'failed' GROUP BY error_message")
def archive_analysis(spark, sf):
    c = chunks(spark, sf).where("status = 'failed'").groupBy("error_message")
    return c.agg(F.count("*").alias("n"), F.bround(F.avg("retry_count"), 4).alias("avg_retries"), F.max("latency_ms").alias("worst"))


@R.add("severity_tally", "SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F') = 0 AS passed FROM orders GROUP BY o_orderpriority")
def severity_tally(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderstatus") == "F") == 0).alias("passed"))


@R.add("reconciliation", f"WITH {JOBS} SELECT CASE WHEN status = 'success' THEN 'paid' WHEN status = 'failed' AND created_at < TIMESTAMP '1996-01-01' THEN 'closed' ELSE 'skipped' END AS action, count(*) AS n FROM jobs GROUP BY 1")
def reconciliation(spark, sf):
    s = F.col("status")
    action = F.when(s == "success", "paid").when((s == "failed") & (F.col("created_at") < F.lit("1996-01-01").cast("timestamp")), "closed").otherwise("skipped")
    return jobs(spark, sf).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@R.add("route_ranking", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal < 0 THEN 1000000 ELSE 0 END + (s_suppkey % 4) * 100000 + floor(abs(s_acctbal)), s_suppkey) AS rank FROM supplier")
def route_ranking(spark, sf):
    """Routes by cooldown, failures and latency, ties by place."""
    score = F.when(F.col("s_acctbal") < 0, 1000000).otherwise(0) + (F.col("s_suppkey") % 4) * 100000 + F.floor(F.abs("s_acctbal"))
    w = Window.partitionBy("s_nationkey").orderBy(score, "s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.row_number().over(w).cast("long").alias("rank"))


@R.add("found_users", "WITH n AS (SELECT DISTINCT user_id FROM events) SELECT n.user_id, c.c_custkey IS NOT NULL AS known FROM n LEFT JOIN customer c ON c.c_custkey = n.user_id")
def found_users(spark, sf):
    """Find or create: users met, and whether the store has them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    return table(spark, sf, "events").select("user_id").distinct().join(c, "user_id", "left").select("user_id", F.coalesce("known", F.lit(False)).alias("known"))


@R.add("claimed_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN user_id % 5 = 0 THEN 42 ELSE user_id END AS owner FROM jobs")
def claimed_jobs(spark, sf):
    return jobs(spark, sf).select("job_id", F.when(F.col("user_id") % 5 == 0, F.lit(42).cast("long")).otherwise(F.col("user_id")).alias("owner"))


@R.add("cleared_progress", f"WITH {CHUNKS}, {JOBS} SELECT job_id, sequence FROM chunks WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed')")
def cleared_progress(spark, sf):
    """A restart drops the chunks of failed jobs."""
    return chunks(spark, sf).join(jobs(spark, sf).where("status = 'failed'").select("job_id"), "job_id", "left_anti").select("job_id", "sequence")


@R.add("backfilled_chunks", f"WITH {CHUNKS}, o AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F') SELECT o.job_id, count(c.sequence) AS n FROM o LEFT JOIN chunks c ON c.job_id = o.job_id AND c.status = 'failed' GROUP BY o.job_id")
def backfilled_chunks(spark, sf):
    """Manifest left-joined with stored failures; the failures are counted before the join."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    c = chunks(spark, sf).where("status = 'failed'").groupBy("job_id").agg(F.count("*").alias("n"))
    return o.join(c, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("n"))


@R.add("balance_status", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'error' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS status FROM customer")
def balance_status(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when(b < 0, "error").when(b < 1000, "low").otherwise("ok").alias("status"))


@R.add("stage_report", f"WITH {CHUNKS} SELECT job_id, array_to_string(list(status || '=' || n ORDER BY status), '; ') AS report FROM (SELECT job_id, status, count(*) AS n FROM chunks GROUP BY job_id, status) GROUP BY job_id")
def stage_report(spark, sf):
    n = chunks(spark, sf).groupBy("job_id", "status").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string"))))
    return n.groupBy("job_id").agg(F.array_join(parts, "; ").alias("report"))


@R.add("log_lines", f"WITH {JOBS} SELECT job_id, '{{\"job\":' || job_id || ',\"status\":\"' || status || '\"}}' AS line FROM jobs")
def log_lines(spark, sf):
    return jobs(spark, sf).select("job_id", F.to_json(F.struct(F.col("job_id").alias("job"), "status")).alias("line"))


@R.add("numeric_casts", "SELECT page_id, TRY_CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS n FROM pages")
def numeric_casts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr("try_cast(regexp_extract(url, '([0-9]+)', 1) as bigint)").alias("n"))


@R.add("wall_times", f"WITH {JOBS}, {CHUNKS}, d AS (SELECT job_id, max(done_at) AS done FROM chunks GROUP BY job_id) SELECT job_id, greatest(0, date_diff('millisecond', created_at, done)) AS wall_ms FROM jobs JOIN d USING (job_id)")
def wall_times(spark, sf):
    d = chunks(spark, sf).groupBy("job_id").agg(F.max("done_at").alias("done"))
    ms = F.timestamp_diff("MILLISECOND", "created_at", "done")
    return jobs(spark, sf).join(d, "job_id").select("job_id", F.greatest(F.lit(0), ms).cast("long").alias("wall_ms"))


@R.add("price_by_cache", "WITH t AS (SELECT lang, length(text) AS n, count(*) OVER (PARTITION BY text) > 1 AS hit FROM documents) SELECT lang, CAST(sum(CASE WHEN hit THEN n // 2 ELSE n END) AS BIGINT) AS billed FROM t GROUP BY lang")
def price_by_cache(spark, sf):
    """Billed characters: cached texts at half price.  Texts meet by their hash, pre-counted."""
    d = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("key"), F.length("text").alias("n"))
    per = d.groupBy("lang", "key").agg(F.count("*").alias("c"), F.sum(F.expr("n div 2")).alias("half"), F.sum("n").alias("full"))
    hits = per.groupBy("key").agg((F.sum("c") > 1).alias("hit"))
    return per.join(hits, "key").groupBy("lang").agg(F.sum(F.when(F.col("hit"), F.col("half")).otherwise(F.col("full"))).alias("billed"))

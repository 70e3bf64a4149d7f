"""Joins, aggregates, windows and store changes over jobs, chunks and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import quality, text
from quirefold.operators import aggregates, ordered, store
from quirefold.plans.base import CHUNKS, JOBS, LINES, Registry, chunks, jobs, lines
from quirefold.plans.stream_queries import LIMIT
from quirefold.session import table

R = Registry()
_LONG = lambda c: F.coalesce(c, F.lit(0)).cast("long")


@R.add("job_status_counts", f"WITH {CHUNKS} SELECT job_id, count(*) AS total, count_if(status = 'translated') AS translated, count_if(status = 'cached') AS cached, count_if(status = 'failed') AS failed FROM chunks GROUP BY job_id", big="translated cached failed")
def job_status_counts(spark, sf):
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return chunks(spark, sf).groupBy("job_id").agg(F.count("*").alias("total"), of("translated"), of("cached"), of("failed"))


@R.add("chapter_status", f"WITH {CHUNKS} SELECT job_id, chapter_id, count(*) AS chunk_total, count_if(status = 'failed') AS chunk_failed, CASE WHEN count_if(status = 'failed') = 0 THEN 'success' WHEN count_if(status <> 'failed') = 0 THEN 'failed' ELSE 'partial' END AS status FROM chunks GROUP BY job_id, chapter_id", big="chunk_failed")
def chapter_status(spark, sf):
    failed = F.count_if(F.col("status") == "failed")
    status = F.when(failed == 0, "success").when(failed == F.count("*"), "failed").otherwise("partial")
    return chunks(spark, sf).groupBy("job_id", "chapter_id").agg(F.count("*").alias("chunk_total"), failed.alias("chunk_failed"), status.alias("status"))


@R.add("flag_counts", f"WITH {CHUNKS} SELECT unnest(flags) AS flag, count(*) AS n FROM chunks GROUP BY 1")
def flag_counts(spark, sf):
    return chunks(spark, sf).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


_ERR = {
    "translator": """CASE WHEN m IS NULL THEN NULL WHEN contains(m, 'untranslated') THEN 'untranslated_response' WHEN contains(m, 'html tag mismatch') THEN 'html_mismatch'
  WHEN contains(m, 'json') OR contains(m, 'parse') THEN 'invalid_json' WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, 'rate limit') OR contains(m, '429') THEN 'rate_limit'
  WHEN contains(m, 'api key') THEN 'auth' WHEN contains(m, 'connect') THEN 'connection' ELSE 'model_error' END""",
    "diagnosed": """CASE WHEN list_contains(flags, 'likely_untranslated') THEN 'untranslated_response' WHEN list_contains(flags, 'html_tag_mismatch') THEN 'html_mismatch'
  WHEN contains(coalesce(m, ''), 'timed out') THEN 'timeout' WHEN contains(coalesce(m, ''), 'rate limit') THEN 'rate_limit' WHEN contains(coalesce(m, ''), 'json') OR contains(coalesce(m, ''), 'parse') THEN 'invalid_json'
  WHEN contains(coalesce(m, ''), 'connect') THEN 'connection' WHEN m IS NOT NULL THEN 'model_error' WHEN len(flags) > 0 THEN 'quality_audit' ELSE 'unknown' END""",
    "archived": """CASE WHEN error_message IS NULL THEN 'unknown' WHEN contains(error_message, 'html tag mismatch') THEN 'html_tag_mismatch' WHEN contains(m, 'json') OR contains(m, 'parse') THEN 'json_parse'
  WHEN contains(m, 'timeout') THEN 'timeout' ELSE left(split_part(error_message, ';', 1), 80) END""",
    "timed": """CASE WHEN list_contains(flags, 'likely_untranslated') THEN 'untranslated_response' WHEN list_contains(flags, 'html_tag_mismatch') THEN 'html_tag_mismatch'
  WHEN contains(coalesce(m, ''), 'json') OR contains(coalesce(m, ''), 'parse') THEN 'json_parse' WHEN contains(coalesce(m, ''), 'timed out') THEN 'timeout' WHEN contains(coalesce(m, ''), 'rate limit') THEN 'rate_limit'
  WHEN contains(coalesce(m, ''), 'connection') THEN 'connection' ELSE 'other' END""",
}


@R.add("error_classes", f"WITH {CHUNKS}, e AS (SELECT *, lower(error_message) AS m FROM chunks) SELECT {', '.join(f'{q} AS {k}' for k, q in _ERR.items())}, count(*) AS n FROM e GROUP BY ALL")
def error_classes(spark, sf):
    """The four error classifications side by side."""
    m, f = F.col("error_message"), F.col("flags")
    c = chunks(spark, sf).select(
        quality.translation_error(m).alias("translator"), quality.diagnosed_error(m, f).alias("diagnosed"), quality.archive_error_key(m).alias("archived"), quality.timing_error(m, f).alias("timed")
    )
    return c.groupBy(*c.columns).agg(F.count("*").alias("n"))


@R.add(
    "latency_summary",
    f"""WITH {CHUNKS}, l AS (SELECT latency_ms AS v FROM chunks WHERE latency_ms > 0), s AS (SELECT list_sort(list(v)) AS vs, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total, max(v) AS worst FROM l)
SELECT samples, total, worst, vs[CAST(round_even((samples - 1) * 0.95, 0) AS INT) + 1] AS p95, vs[CAST(round_even((samples - 1) * 0.99, 0) AS INT) + 1] AS p99 FROM s""",
)
def latency_summary(spark, sf):
    l = chunks(spark, sf).where("latency_ms > 0").withColumn("all", F.lit(1))  # noqa: E741
    s = l.groupBy("all").agg(F.count("*").alias("samples"), F.sum("latency_ms").alias("total"), F.max("latency_ms").alias("worst"))
    return s.join(aggregates.nearest_rank(l, ["all"], "latency_ms", {"p95": 0.95, "p99": 0.99}), "all").drop("all")


@R.add(
    "chapter_latency",
    f"""WITH {CHUNKS}, s AS (SELECT chapter_id, list_sort(list(latency_ms)) AS vs, count(*) AS n FROM chunks WHERE latency_ms > 0 GROUP BY chapter_id)
SELECT chapter_id, vs[CAST(round_even((n - 1) * 0.5, 0) AS INT) + 1] AS p50, vs[CAST(round_even((n - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM s""",
)
def chapter_latency(spark, sf):
    return aggregates.nearest_rank(chunks(spark, sf).where("latency_ms > 0"), ["chapter_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})


@R.add(
    "job_bottlenecks",
    f"""WITH {CHUNKS}, {JOBS}, t AS (SELECT job_id, sum(latency_ms) AS model, count_if(latency_ms > 0) AS calls, count(*) AS chunks, sum(retry_count) AS retries, count_if(status = 'failed') AS failed FROM chunks GROUP BY job_id),
w AS (SELECT t.*, CAST(floor(amount) AS BIGINT) AS wall, model + 1000 * chunks AS attributed FROM t JOIN jobs USING (job_id))
SELECT job_id, CASE WHEN wall - attributed >= greatest(60000, 2 * attributed) AND (wall - attributed) / greatest(wall, 1) >= 0.5 THEN 'unattributed_wait' WHEN retries > greatest(3.0, chunks * 0.1) OR failed > 0 THEN 'model_stability'
  WHEN model / greatest(wall, 1) >= 0.6 THEN 'model_latency' WHEN (attributed - model) / greatest(wall, 1) >= 0.45 THEN 'server_pipeline' WHEN calls > 0 AND chunks / calls < 3 THEN 'orchestration' ELSE 'unknown' END AS bottleneck FROM w""",
)
def job_bottlenecks(spark, sf):
    """Timing report's verdict: both sides are aggregated or narrow before the one join."""
    t = chunks(spark, sf).groupBy("job_id").agg(
        F.sum("latency_ms").alias("model"), F.count_if(F.col("latency_ms") > 0).alias("calls"), F.count("*").alias("chunks"), F.sum("retry_count").alias("retries"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    w = t.join(jobs(spark, sf).select("job_id", F.floor("amount").alias("wall")), "job_id").withColumn("attributed", F.col("model") + 1000 * F.col("chunks"))
    return w.select("job_id", aggregates.bottleneck(*(F.col(c) for c in ("wall", "attributed", "model", "calls", "chunks", "retries", "failed"))).alias("bottleneck"))


@R.add(
    "token_costs",
    f"""WITH {CHUNKS} SELECT job_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  round_even((sum(prompt_tokens) * 1.0 + sum(completion_tokens) * 4.0) / 1000000, 4) AS cost, round_even(count_if(status = 'cached') / count(*), 4) AS cache_ratio FROM chunks GROUP BY job_id""",
)
def token_costs(spark, sf):
    p, c = F.sum("prompt_tokens"), F.sum("completion_tokens")
    cached = F.count_if(F.col("status") == "cached")
    return chunks(spark, sf).groupBy("job_id").agg(
        p.alias("prompt_tokens"), c.alias("completion_tokens"), F.bround((p + c * 4.0) / 1000000, 4).alias("cost"), F.bround(cached / F.count("*"), 4).alias("cache_ratio")
    )


@R.add("failed_job_codes", f"WITH {JOBS} SELECT coalesce(error_code, 'UNKNOWN') AS error_code, count(*) AS n FROM jobs WHERE status = 'failed' AND created_at >= TIMESTAMP '1995-01-01' GROUP BY 1")
def failed_job_codes(spark, sf):
    j = jobs(spark, sf).where((F.col("status") == "failed") & (F.col("created_at") >= F.lit("1995-01-01").cast("timestamp")))
    return j.groupBy(F.coalesce("error_code", F.lit("UNKNOWN")).alias("error_code")).agg(F.count("*").alias("n"))


@R.add("daily_visits", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, count(*) AS pv, count(DISTINCT user_id) AS uv FROM events GROUP BY GROUPING SETS ((date_trunc('day', ts)), ())")
def daily_visits(spark, sf):
    """Views and distinct visitors by day, and over all days."""
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return e.groupingSets([["day"], []], "day").agg(F.count("*").alias("pv"), F.count_distinct("user_id").alias("uv"))


@R.add("event_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def event_quota(spark, sf):
    """The first three events of a user and day are allowed.

    Tasks pass on three rows a key at most, however many it has; the rest
    learn of it by their id.
    """
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    first = e.withColumn("n", F.row_number().over(w)).where("n <= 3").select("event_id", F.lit(True).alias("ok"))
    return e.join(first, "event_id", "left").select("event_id", F.coalesce("ok", F.lit(False)).alias("allowed"))


@R.add(
    "batch_rollup",
    f"""WITH {JOBS} SELECT batch_id, count(*) AS total, count_if(status = 'success') AS completed, count_if(status = 'failed') AS failed, CAST(round_even(100.0 * count_if(status IN ('success', 'failed')) / count(*), 0) AS BIGINT) AS progress,
  CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'success') THEN 'completed' WHEN bool_or(status = 'success') AND bool_or(status = 'failed') THEN 'partial_completed' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'running' END AS status FROM jobs GROUP BY batch_id""", big="completed failed")
def batch_rollup(spark, sf):
    s = F.col("status")
    done = F.count_if(s.isin("success", "failed"))
    return jobs(spark, sf).groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(s == "success").alias("completed"), F.count_if(s == "failed").alias("failed"), F.bround(done * 100.0 / F.count("*"), 0).cast("long").alias("progress"), aggregates.batch_status(s).alias("status")
    )


@R.add(
    "qa_reports",
    f"""WITH {CHUNKS}, s AS (SELECT job_id, count_if(status = 'failed') AS f, count_if(list_contains(flags, 'likely_untranslated')) AS u, count_if(list_contains(flags, 'html_tag_mismatch')) AS a, count_if(list_contains(flags, 'glossary_review')) AS w FROM chunks GROUP BY job_id)
SELECT job_id, CAST(greatest(0, 100 - (CASE WHEN f > 0 THEN least(80, 20 + 2 * f) ELSE 0 END + CASE WHEN u > 0 THEN least(60, 20 + 3 * u) ELSE 0 END + CASE WHEN a > 0 THEN least(50, 2 * a) ELSE 0 END)) AS INTEGER) AS score,
  CASE WHEN f + u + a > 0 THEN 'failed' WHEN w > 0 THEN 'warning' ELSE 'passed' END AS status, f + u + a > 0 AS retryable FROM s""",
)
def qa_reports(spark, sf):
    has = lambda f: F.count_if(F.array_contains("flags", f))
    s = chunks(spark, sf).groupBy("job_id").agg(F.count_if(F.col("status") == "failed").alias("f"), has("likely_untranslated").alias("u"), has("html_tag_mismatch").alias("a"), has("glossary_review").alias("w"))
    no = F.lit(False)
    r = quality.qa_report(F.col("f"), F.col("u"), F.col("a"), F.col("w"), F.lit(0), no, no, no, F.lit(0))
    return s.select("job_id", r.alias("r")).select("job_id", "r.score", "r.status", "r.retryable")


@R.add("delivery_gate", f"WITH {CHUNKS} SELECT chapter_id, count(*) AS total, count_if(status = 'failed') AS failed FROM chunks GROUP BY chapter_id HAVING count_if(status = 'failed') > 20 AND count_if(status = 'failed') / count(*) > 0.02", big="failed")
def delivery_gate(spark, sf):
    c = chunks(spark, sf).groupBy("chapter_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    return c.where((F.col("failed") > 20) & (F.col("failed") / F.col("total") > 0.02))


@R.add("archive_candidates", f"WITH {CHUNKS} SELECT job_id, sequence FROM chunks WHERE status = 'failed' OR error_message IS NOT NULL OR retry_count >= 2")
def archive_candidates(spark, sf):
    return chunks(spark, sf).where("status = 'failed' or error_message is not null or retry_count >= 2").select("job_id", "sequence")


@R.add("slowest_chunks", f"WITH {CHUNKS} SELECT job_id, sequence, latency_ms FROM chunks ORDER BY latency_ms DESC, job_id, sequence LIMIT 10")
def slowest_chunks(spark, sf):
    return chunks(spark, sf).orderBy(F.desc("latency_ms"), "job_id", "sequence").limit(10).select("job_id", "sequence", "latency_ms")


@R.add("failed_samples", f"WITH {CHUNKS} SELECT job_id, sequence, status, retry_count FROM chunks ORDER BY status = 'failed' DESC, retry_count DESC, job_id, sequence LIMIT 8")
def failed_samples(spark, sf):
    return chunks(spark, sf).orderBy(F.desc(F.col("status") == "failed"), F.desc("retry_count"), "job_id", "sequence").limit(8).select("job_id", "sequence", "status", "retry_count")


@R.add("archive_top", f"WITH {CHUNKS} SELECT job_id, sequence, retry_count, latency_ms FROM chunks WHERE status = 'failed' ORDER BY retry_count DESC, latency_ms DESC, job_id, sequence LIMIT 5")
def archive_top(spark, sf):
    return chunks(spark, sf).where("status = 'failed'").orderBy(F.desc("retry_count"), F.desc("latency_ms"), "job_id", "sequence").limit(5).select("job_id", "sequence", "retry_count", "latency_ms")


@R.add("newest_jobs", f"WITH {JOBS} SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 50")
def newest_jobs(spark, sf):
    return jobs(spark, sf).orderBy(F.desc("created_at"), "job_id").limit(50).select("job_id", "status", "created_at")


@R.add("jobs_of_users", f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id) AS rank FROM jobs) SELECT user_id, job_id, rank FROM r WHERE rank <= 5")
def jobs_of_users(spark, sf):
    """Recent history: five newest jobs of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "job_id")
    return jobs(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("user_id", "job_id", "rank")


@R.add("api_status", f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' THEN 'running' WHEN error_code = 'PARTIAL_TRANSLATION' THEN 'qa_failed' WHEN status = 'success' THEN 'completed' ELSE 'failed' END AS status, status = 'success' AND coalesce(error_code, '') <> 'PARTIAL_TRANSLATION' AS can_download FROM jobs")
def api_status(spark, sf):
    s, e = F.col("status"), F.coalesce("error_code", F.lit(""))
    v2 = (
        F.when(s == "pending_payment", "pending_payment").when(s == "pending", "queued").when(s == "running", "running")
        .when((e == "PARTIAL_TRANSLATION") & s.isin("success", "failed"), "qa_failed").when(s == "success", "completed").when(s == "failed", "failed").when(s == "cancelled", "cancelled").otherwise("running")
    )
    return jobs(spark, sf).select("job_id", v2.alias("status"), ((s == "success") & (e != "PARTIAL_TRANSLATION")).alias("can_download"))


# joins


@R.add("chunks_with_files", f"WITH {CHUNKS} SELECT job_id, sequence, coalesce(p.p_name, 'text/' || chapter_id || '.html') AS file FROM chunks c LEFT JOIN part p ON p.p_partkey = c.job_id AND p.p_size > 25")
def chunks_with_files(spark, sf):
    """Left join with a default file name."""
    p = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("job_id"), "p_name")
    return chunks(spark, sf).join(p, "job_id", "left").select("job_id", "sequence", F.coalesce("p_name", F.concat(F.lit("text/"), F.col("chapter_id").cast("string"), F.lit(".html"))).alias("file"))


@R.add("cache_hits", "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id FROM d WHERE key IN (SELECT key FROM d GROUP BY key HAVING count(*) > 1)")
def cache_hits(spark, sf):
    """Semi-join on the cache key: texts met more than once."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.join(d.groupBy("key").count().where("count > 1"), "key", "left_semi").select("doc_id")


@R.add("cache_misses", "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id FROM d WHERE key NOT IN (SELECT sha256(text) FROM benchmark)")
def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.join(table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("key")), "key", "left_anti").select("doc_id")


@R.add(
    "turn_pairs",
    "WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) SELECT conv_id, turn, length(text) AS source_chars, length(answer) AS answer_chars FROM t WHERE role = 'user' AND next_role = 'assistant'",
)
def turn_pairs(spark, sf):
    """Pairs by position: a user turn and the assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("source_chars"), F.length("answer").cast("long").alias("answer_chars"))


@R.add("neighbour_context", "SELECT conv_id, turn, right(lag(text) OVER w, 500) AS previous, left(lead(text) OVER w, 500) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_context(spark, sf):
    return ordered.neighbours(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "next")


@R.add(
    "preceding_headings",
    rf"""WITH {LINES}, h AS (SELECT doc_id, pos, CASE WHEN length(line) < 40 THEN line END AS heading FROM lines) SELECT doc_id, pos, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h""",
)
def preceding_headings(spark, sf):
    """As-of join backward: a line's nearest heading before it (short lines count as headings)."""
    return ordered.carried(lines(spark, sf), ["doc_id"], "pos", F.when(F.length("line") < 40, F.col("line")), "heading").select("doc_id", "pos", "heading")


@R.add(
    "current_attempt_events",
    "WITH a AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS started FROM events GROUP BY user_id) SELECT e.event_id FROM events e JOIN a USING (user_id) WHERE e.event_type = 'purchase' OR e.ts >= a.started",
)
def current_attempt_events(spark, sf):
    """Equi-join with a range residual: events of the attempt, or after its start."""
    e = table(spark, sf, "events")
    a = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("started"))
    return e.join(a, "user_id").where("event_type = 'purchase' or ts >= started").select("event_id")


@R.add(
    "glossary_precedence",
    "WITH g AS (SELECT n_name AS src, 'auto' AS dst, 1 AS priority FROM nation UNION ALL SELECT n_name, 'global', 2 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'user', 3 FROM nation WHERE n_nationkey % 3 = 0) SELECT src, arg_max(dst, priority) AS dst FROM g GROUP BY src",
)
def glossary_precedence(spark, sf):
    """Automatic terms give way to global ones, those to the user's."""
    n = table(spark, sf, "nation")
    part = lambda c, dst, p: n.where(c).select(F.col("n_name").alias("src"), F.lit(dst).alias("dst"), F.lit(p).alias("priority"))
    g = part("true", "auto", 1).unionByName(part("n_nationkey % 2 = 0", "global", 2)).unionByName(part("n_nationkey % 3 = 0", "user", 3))
    return g.groupBy("src").agg(F.max_by("dst", "priority").alias("dst"))


@R.add(
    "terms_in_texts",
    r"""WITH t AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]{4,}') AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)
SELECT doc_id, term FROM w JOIN t ON w.word = lower(t.term) WHERE term <> ''""",
)
def terms_in_texts(spark, sf):
    """Containment join of texts and single-word terms, as an equi-join on words."""
    t = table(spark, sf, "benchmark").select(F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("term")).where("term <> ''").distinct()
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    w = table(spark, sf, "documents").select("doc_id", F.explode(words).alias("word"))
    return w.join(t, F.col("word") == F.lower("term")).select("doc_id", "term")


@R.add("document_titles", "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), url) AS title FROM pages")
def document_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")), F.col("url")).alias("title"))


# order-dependent


@R.add(
    "chunk_batches",
    f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT job_id, sequence, prompt_tokens AS cost, retry_count = 3 AS single, row_number() OVER (PARTITION BY job_id ORDER BY sequence, prompt_tokens, retry_count = 3) AS n FROM chunks WHERE prompt_tokens > 0),
r AS (
  SELECT job_id, n, sequence, 0 AS batch, CASE WHEN single THEN 1 ELSE 0 END AS open, CASE WHEN single THEN 0 ELSE cost END AS used, single AS fresh FROM c WHERE n = 1
  UNION ALL
  SELECT job_id, n, sequence, now, CASE WHEN single THEN now + 1 ELSE now END, CASE WHEN single THEN 0 WHEN now > open THEN cost ELSE used + cost END, single FROM (
    SELECT c.*, r.open, r.used, r.open + CASE WHEN NOT r.fresh AND (c.single OR r.used + c.cost > 600) THEN 1 ELSE 0 END AS now FROM r JOIN c ON c.job_id = r.job_id AND c.n = r.n + 1)
)
SELECT job_id, sequence, CAST(batch AS INTEGER) AS batch FROM r""",
)
def chunk_batches(spark, sf):
    """Greedy batches of chunks by prompt size; a job's chunks are few, so they fold in one row."""
    c = chunks(spark, sf).where("prompt_tokens > 0").groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", F.col("prompt_tokens").alias("cost"), (F.col("retry_count") == 3).alias("single")))).alias("items")
    )
    return c.select("job_id", F.posexplode(F.arrays_zip(F.col("items.sequence").alias("sequence"), ordered.greedy_batches(F.col("items"), 600).alias("batch"))).alias("at", "b")).select("job_id", "b.sequence", "b.batch")


@R.add(
    "smoothed_latency",
    f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT job_id, CAST(latency_ms AS DOUBLE) AS v, row_number() OVER (PARTITION BY job_id ORDER BY sequence, latency_ms) AS n FROM chunks WHERE latency_ms > 0),
r AS (SELECT job_id, n, v AS s FROM c WHERE n = 1 UNION ALL SELECT c.job_id, c.n, r.s * CAST(0.7 AS DOUBLE) + c.v * (1 - CAST(0.7 AS DOUBLE)) FROM r JOIN c ON c.job_id = r.job_id AND c.n = r.n + 1)
SELECT job_id, round(arg_max(s, n), 6) AS latency FROM r GROUP BY job_id""",
)
def smoothed_latency(spark, sf):
    c = chunks(spark, sf).where("latency_ms > 0").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "latency_ms"))).alias("x"))
    return c.select("job_id", F.round(ordered.smoothed(F.col("x.latency_ms")), 6).alias("latency"))


@R.add(
    "adaptive_limits",
    LIMIT.format(events=f"{CHUNKS}, a AS (SELECT job_id AS key, sequence AS event_id, row_number() OVER (PARTITION BY job_id ORDER BY sequence, status <> 'failed', latency_ms) AS n, status <> 'failed' AS ok, status <> 'failed' AND latency_ms <= 20000 AS fast FROM chunks)", streak=6)
    + " SELECT key AS job_id, CAST(arg_max(current, n) AS INTEGER) AS \"limit\" FROM r GROUP BY key",
)
def adaptive_limits(spark, sf):
    ok = F.col("status") != "failed"
    c = chunks(spark, sf).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sequence", ok.alias("ok"), F.col("latency_ms").alias("latency")))).alias("x"))
    return c.select("job_id", ordered.adaptive_limit(F.col("x"), 6).alias("limit"))


@R.add("chapter_samples", f"WITH {CHUNKS}, r AS (SELECT job_id, sequence, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM chunks WINDOW w AS (PARTITION BY job_id ORDER BY sequence)) SELECT job_id, sequence FROM r WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1)")
def chapter_samples(spark, sf):
    """Five evenly spread chunks of each job."""
    w = Window.partitionBy("job_id")
    r = chunks(spark, sf).withColumns({"i": F.row_number().over(w.orderBy("sequence")) - 1, "n": F.count("*").over(w)})
    return r.where("i in (0, n div 4, n div 2, 3 * n div 4, n - 1)").select("job_id", "sequence")


@R.add("current_stages", "SELECT user_id, arg_max(event_type, ts) AS stage, least(90, 25 * count(*)) AS progress FROM (SELECT user_id, event_type, ts + to_microseconds(event_id % 1000) AS ts FROM events) GROUP BY user_id")
def current_stages(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, (event_id % 1000) / 1000000.0)"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("stage"), F.least(F.lit(90), 25 * F.count("*")).alias("progress"))


@R.add("latest_cache_rows", "SELECT left(text, 20) AS key, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def latest_cache_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.left("text", F.lit(20)).alias("key"), "doc_id", "lang")
    return ordered.latest_wins(d, ["key"], ["doc_id"])


@R.add("distinct_progress", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def distinct_progress(spark, sf):
    """Consecutive equal events of a user reduced to the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where("before is null or before <> event_type").select("event_id")


@R.add("effective_chars", "SELECT lang, CAST(sum(length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS chars FROM (SELECT lang, arg_min(text, doc_id) AS text FROM documents GROUP BY lang, left(text, 500)) GROUP BY lang")
def effective_chars(spark, sf):
    """Characters that count: texts with equal beginnings once, without white space."""
    d = table(spark, sf, "documents").select("lang", F.left("text", F.lit(500)).alias("key"), "doc_id", F.length(F.regexp_replace("text", r"\s", "")).alias("n"))
    return d.groupBy("lang", "key").agg(F.min_by("n", "doc_id").alias("n")).groupBy("lang").agg(F.sum("n").alias("chars"))


@R.add(
    "price_quotes",
    """WITH c AS (SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang)
SELECT lang, chars, CAST(least(99999.0, greatest(5.99, round_even(CAST(chars AS DOUBLE) / 1000 * 0.1, 2))) AS DOUBLE) AS translation,
  CAST(CASE WHEN chars <= 150000 THEN 3.99 WHEN chars <= 300000 THEN 5.99 WHEN chars <= 600000 THEN 8.99 WHEN chars <= 1000000 THEN 12.99 ELSE 12.99 + 4.0 * ceil((chars - 1000000) / 500000) END AS DOUBLE) AS polish FROM c""",
)
def price_quotes(spark, sf):
    c = table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    return c.select("lang", "chars", aggregates.translation_price(F.col("chars")).alias("translation"), aggregates.polish_price(F.col("chars")).cast("double").alias("polish"))


# store changes


@R.add("claim_payments", f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND batch_index = 0 THEN 'pending' ELSE status END AS status, status = 'running' AND batch_index = 0 AS won FROM jobs")
def claim_payments(spark, sf):
    j = jobs(spark, sf).withColumn("status", F.when(F.col("status") == "running", "pending_payment").otherwise(F.col("status")))
    out = store.compare_and_set(j, "status", "pending_payment", "pending", F.col("batch_index") == 0)
    return out.select("job_id", F.when(F.col("status") == "pending_payment", "running").otherwise(F.col("status")).alias("status"), "won")


@R.add("claim_batches", f"WITH {JOBS}, won AS (SELECT batch_id FROM jobs WHERE batch_index = 0 AND status = 'running') SELECT job_id FROM jobs WHERE batch_id IN (SELECT batch_id FROM won) AND status = 'running'")
def claim_batches(spark, sf):
    """A batch goes on only if its leader could be claimed; then all its open members."""
    j = jobs(spark, sf)
    won = j.where("batch_index = 0 and status = 'running'").select("batch_id")
    return j.where("status = 'running'").join(won, "batch_id", "left_semi").select("job_id")


@R.add("expired_payments", f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '1998-06-01' - INTERVAL 30 MINUTE THEN 'cancelled' WHEN status = 'running' THEN 'pending_payment' ELSE status END AS status FROM jobs")
def expired_payments(spark, sf):
    j = jobs(spark, sf).withColumn("status", F.when(F.col("status") == "running", "pending_payment").otherwise(F.col("status")))
    return store.expire(j, "status", "created_at", F.lit("1998-06-01").cast("timestamp"), 30).select("job_id", "status")


@R.add("upserted_chunks", f"WITH {CHUNKS}, a AS (SELECT job_id, sequence, status, 1 AS v FROM chunks UNION ALL SELECT job_id, sequence, 'retried', 2 FROM chunks WHERE status = 'failed') SELECT job_id, sequence, arg_max(status, v) AS status FROM a GROUP BY job_id, sequence")
def upserted_chunks(spark, sf):
    c = chunks(spark, sf).select("job_id", "sequence", "status", F.lit(1).alias("v"))
    again = c.where("status = 'failed'").select("job_id", "sequence", F.lit("retried").alias("status"), F.lit(2).alias("v"))
    return store.upsert(c, again, ["job_id", "sequence"], "v").drop("v")


@R.add("fenced_writes", f"WITH {CHUNKS}, {JOBS} SELECT job_id, sequence FROM chunks c WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = c.job_id AND j.user_id % 4 = c.retry_count)")
def fenced_writes(spark, sf):
    attempts = jobs(spark, sf).select("job_id", (F.col("user_id") % 4).alias("retry_count"))
    return store.fenced(chunks(spark, sf), attempts, "job_id", "retry_count").select("job_id", "sequence")


@R.add("job_transitions", f"""WITH {JOBS}, a AS (SELECT *, CASE job_id % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'restart' ELSE 'cancel' END AS action FROM jobs)
SELECT job_id, action, CASE WHEN action = 'retry' AND error_code = 'PARTIAL_TRANSLATION' THEN 'pending' WHEN action = 'restart' AND status IN ('success', 'failed') THEN 'pending' WHEN action = 'cancel' AND status = 'running' THEN 'cancelled' ELSE status END AS next FROM a""")
def job_transitions(spark, sf):
    k = F.col("job_id") % 3
    a = jobs(spark, sf).withColumn("action", F.when(k == 0, "retry").when(k == 1, "restart").otherwise("cancel"))
    return a.select("job_id", "action", store.transition(F.col("status"), F.col("action"), F.col("error_code")).alias("next"))


@R.add("rescued_chunks", f"WITH {CHUNKS} SELECT job_id, sequence, CASE WHEN status = 'failed' AND retry_count < 2 THEN 'rescued' ELSE status END AS status FROM chunks")
def rescued_chunks(spark, sf):
    """Failed chunks with budget left get a rescue round; results are joined back by key."""
    c = chunks(spark, sf)
    rescued = c.where("status = 'failed' and retry_count < 2").select("job_id", "sequence", F.lit("rescued").alias("fixed"))
    return c.join(rescued, ["job_id", "sequence"], "left").select("job_id", "sequence", F.coalesce("fixed", "status").alias("status"))


@R.add("output_names", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE printf('%02d-', n) || p_brand END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part)")
def output_names(spark, sf):
    """Repeated names in a package get a running number."""
    n = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("n", n).select("p_partkey", F.when(F.col("n") == 1, F.col("p_brand")).otherwise(F.concat(F.format_string("%02d-", "n"), F.col("p_brand"))).alias("name"))


@R.add("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_valid(props)")
def event_props(spark, sf):
    """JSON with a fixed schema; malformed rows drop."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p")).where("p is not null").select("event_id", "p.k")


@R.add("common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@R.add("unlabelled_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("admission", f"WITH {JOBS}, r AS (SELECT job_id, batch_id, sum(CAST(floor(amount) AS BIGINT)) OVER (PARTITION BY batch_id ORDER BY batch_index, job_id ROWS UNBOUNDED PRECEDING) AS running FROM jobs) SELECT job_id, running <= 400000 AS admitted FROM r")
def admission(spark, sf):
    """Running total of a batch against its limit."""
    w = Window.partitionBy("batch_id").orderBy("batch_index", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    return jobs(spark, sf).select("job_id", (F.sum(F.floor("amount")).over(w) <= 400000).alias("admitted"))

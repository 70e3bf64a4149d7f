"""Streams over the events table, run to their end, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.plans.base import Registry
from quirefold.session import table
from quirefold.streaming import keyed

R = Registry()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream."""
    own = keyed.session(spark)
    return own.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be a file


_IN_ORDER = "e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
# watermark at the end: the latest event's millisecond
_END = "(SELECT epoch_ms(max(ts)) FROM events)"

HOUR = 3600


@R.add(
    "stream_codes",
    f"""WITH RECURSIVE {_IN_ORDER}, a AS (SELECT user_id, event_id, us, n, event_type IN ('signup', 'view', 'click') AS request, event_type = 'purchase' AS good FROM e),
r AS (
  SELECT user_id, n, event_id, us, CASE WHEN request THEN 'sent' ELSE 'refused' END AS outcome,
    CASE WHEN request THEN event_id END AS sent, CASE WHEN request THEN us + 36000000000 ELSE 0 END AS until, CASE WHEN request THEN us + 14400000000 ELSE 0 END AS lock,
    CAST(NULL AS BIGINT) AS lapsed
  FROM a WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, us, outcome,
    CASE WHEN outcome = 'sent' THEN event_id WHEN outcome = 'accepted' THEN NULL ELSE live END,
    CASE WHEN outcome = 'sent' THEN us + 36000000000 WHEN outcome = 'accepted' OR live IS NULL THEN 0 ELSE until END,
    CASE WHEN outcome = 'sent' THEN us + 14400000000 ELSE lock END, gone
  FROM (
    SELECT a.user_id, a.n, a.event_id, a.us, r.until, r.lock, CASE WHEN r.until > a.us THEN r.sent END AS live, CASE WHEN r.until <= a.us THEN r.sent END AS gone,
      CASE WHEN a.request THEN CASE WHEN r.lock > a.us THEN 'locked' ELSE 'sent' END WHEN a.good AND r.sent IS NOT NULL AND r.until > a.us THEN 'accepted' ELSE 'refused' END AS outcome
    FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1)
), last AS (
  SELECT user_id, arg_max(sent, n) AS sent, arg_max(until, n) AS until, max(n) AS n FROM r GROUP BY user_id
)
SELECT user_id, event_id, outcome FROM r
UNION ALL SELECT user_id, lapsed, 'lapsed' FROM r WHERE lapsed IS NOT NULL
UNION ALL SELECT l.user_id, l.sent, 'lapsed' FROM last AS l JOIN r USING (user_id, n) WHERE r.sent IS NOT NULL AND r.until <= {_END} * 1000""",
)
def stream_codes(spark, sf):
    """ST2: codes of ten hours and a lock of four (the events of a user lie hours apart)."""
    kind = F.col("event_type")
    e = _events(spark, sf).select(
        "user_id", "event_id", "ts",
        F.when(kind.isin("signup", "view", "click"), "request").otherwise("try").alias("action"),
        F.when(kind == "error", "wrong").otherwise(F.col("user_id").cast("string")).alias("code"),
    )
    return keyed.run_to_end(keyed.folded(e, keyed.one_time_codes(10 * HOUR, 4 * HOUR)), "codes")


@R.add(
    "stream_cooldowns",
    f"""WITH RECURSIVE {_IN_ORDER}, a AS (SELECT user_id, event_id, us, n, event_type NOT IN ('error', 'signup') AS ok, value AS latency FROM e),
r AS (
  SELECT user_id, n, event_id, ok, FALSE AS cooling, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CASE WHEN ok THEN 0 ELSE us + 18000000000 END AS until,
    CASE WHEN ok THEN latency END AS smooth, CASE WHEN NOT ok THEN event_id END AS last, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS INTEGER) AS opened_failures, CAST(NULL AS DOUBLE) AS opened_smooth
  FROM a WHERE n = 1
  UNION ALL
  SELECT a.user_id, a.n, a.event_id, a.ok, r.until > a.us, CASE WHEN a.ok THEN greatest(0, r.failures - 1) ELSE least(10, r.failures + 1) END,
    CASE WHEN a.ok THEN 0 ELSE a.us + least(60, 5 * least(10, r.failures + 1)) * 3600000000 END,
    CASE WHEN NOT a.ok THEN r.smooth WHEN r.smooth IS NULL THEN a.latency ELSE r.smooth * CAST(0.7 AS DOUBLE) + a.latency * (1 - CAST(0.7 AS DOUBLE)) END,
    CASE WHEN NOT a.ok THEN a.event_id END,
    CASE WHEN r.until <= a.us THEN r.last END, r.failures, r.smooth
  FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1
), last AS (
  SELECT user_id, max(n) AS n FROM r GROUP BY user_id
), out AS (
  SELECT user_id, event_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS outcome, cooling, failures, smooth FROM r
  UNION ALL SELECT user_id, opened, 'open', FALSE, opened_failures, opened_smooth FROM r WHERE opened IS NOT NULL
  UNION ALL SELECT user_id, r.last, 'open', FALSE, failures, smooth FROM r JOIN last USING (user_id, n) WHERE until > 0 AND until <= {_END} * 1000
)
SELECT user_id, event_id, outcome, cooling, CAST(failures AS INTEGER) AS failures, CAST(floor(smooth * 1000) AS BIGINT) AS latency FROM out""",
)
def stream_cooldowns(spark, sf):
    """ST8: cooldowns of 5 hours a failure, 60 at most (seconds in service, hours here)."""
    e = _events(spark, sf).select("user_id", "event_id", "ts", (~F.col("event_type").isin("error", "signup")).alias("ok"), F.col("value").alias("latency"))
    out = keyed.run_to_end(keyed.folded(e, keyed.route_cooldowns(5 * HOUR, 60 * HOUR)), "cooldowns")
    return out.withColumn("latency", F.floor(F.col("latency") * 1000))


#: The fold of adaptive limits over a(key, n, event_id, ok, fast).
LIMIT = """WITH RECURSIVE {events}, r AS (
  SELECT key, n, event_id, CASE WHEN ok THEN 6 ELSE 5 END AS current, CASE WHEN fast THEN 1 ELSE 0 END AS run, CASE WHEN ok THEN 6 ELSE 5 END AS lowest, CASE WHEN ok THEN 0 ELSE 1 END AS downs, 0 AS ups FROM a WHERE n = 1
  UNION ALL
  SELECT key, n, event_id, current + up - down, CASE WHEN fast AND run + 1 < {streak} THEN run + 1 ELSE 0 END, least(lowest, current + up - down), downs + down, ups + up FROM (
    SELECT a.key, a.n, a.event_id, a.fast, r.current, r.run, r.lowest, r.downs, r.ups,
      CASE WHEN a.fast AND r.run + 1 >= {streak} AND r.current < 6 THEN 1 ELSE 0 END AS up, CASE WHEN NOT a.ok AND r.current > 2 THEN 1 ELSE 0 END AS down
    FROM r JOIN a ON a.key = r.key AND a.n = r.n + 1)
)"""


@R.add(
    "stream_limits",
    LIMIT.format(events=f"{_IN_ORDER}, a AS (SELECT user_id AS key, n, event_id, event_type <> 'error' AS ok, event_type <> 'error' AND value <= 60 AS fast FROM e)", streak=3)
    + " SELECT key AS user_id, event_id, CAST(current AS INTEGER) AS current, CAST(lowest AS INTEGER) AS lowest, CAST(downs AS INTEGER) AS downs, CAST(ups AS INTEGER) AS ups FROM r",
)
def stream_limits(spark, sf):
    """ST7: the concurrency of each user after each event, up after three fast successes."""
    e = _events(spark, sf).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return keyed.run_to_end(keyed.folded(e, keyed.adaptive_limits(streak=3, slow=60)), "limits")

"""Streams of job and visit events on Structured Streaming.

State is kept per key by Spark, bounded by watermarks or timeouts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as an instant (tables may hold local timestamps; the session's zone applies)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_visits(events: DataFrame, ts: str = "ts", visitor: str = "user_id", late: str = "1 day") -> DataFrame:
    """Views and visitors (approximately distinct) by day; rows later than the watermark drop."""
    day = F.window(ts, "1 day")
    return (
        timed(events, ts).withWatermark(ts, late)
        .groupBy(day.alias("w"))
        .agg(F.count("*").alias("pv"), F.approx_count_distinct(visitor).alias("uv"))
        .select(F.col("w.start").alias("day"), "pv", "uv")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """At-least-once delivery made idempotent."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def quota(events: DataFrame, limit: int = 3, key: str = "user_id") -> DataFrame:
    """(key, event_id, allowed): at most ``limit`` events a key and day pass; a refused one is not counted."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            allowed = [used + i < limit for i in range(len(f))]
            used = min(limit, used + len(f))
            yield pd.DataFrame({key: [k[0]] * len(f), "event_id": f["event_id"].to_numpy(), "allowed": allowed})
        state.update((used,))
        end = pd.Timestamp(k[1]) + pd.Timedelta(days=1)
        if int(end.timestamp() * 1000) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(end.timestamp() * 1000))

    day = timed(events).withWatermark("ts", "1 day").withColumn("day", F.date_trunc("day", "ts"))
    return day.groupBy(key, "day").applyInPandasWithState(run, f"{key} long, event_id long, allowed boolean", "used int", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(events: DataFrame, seconds: float = 5.0, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts): events of a key at least ``seconds`` after the last one passed on."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            keep = []
            f = f.sort_values(["ts", "event_id"])
            for t in f["ts"]:
                now = t.timestamp()
                ok = last is None or now - last >= seconds
                last = now if ok else last
                keep.append(ok)
            yield f.loc[keep, [key, "event_id", "ts"]]
        state.update((last,))

    return timed(events).withWatermark("ts", "1 day").groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def fenced_sink(target: str, current_attempts: Callable[[], DataFrame], key: str = "job_id", attempt: str = "attempt_id") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: only the current attempt's rows are written, once an epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.join(current_attempts().select(key, attempt), [key, attempt], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write

"""State a key with times of its own: a fold over a key's events, and timers for what lapses.

``folded`` keeps one small state a key (``transformWithState``).  Decisions
are made as events arrive: a key's clock is the latest event time seen, a
batch's events are taken in order of (ts, event_id), and one that comes late
(but within the watermark) is taken at the clock.  What a state holds only
until some time lapses at the key's next event or, for quiet keys, by a timer
when the watermark has passed that time; a state that holds nothing more is
removed, so state does not grow with the keys ever seen.

A key's events of one micro-batch are held in a task; bound a batch with
``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.  Rows without a key are one
key; events without a time are left out.  Needs the RocksDB state store
(``session``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quirefold.session import shared_dir

#: Microseconds of a second: event times are whole microseconds here.
SECOND = 1_000_000


@dataclass(frozen=True)
class Fold:
    """A fold over a key's events; times are microseconds since 1970."""

    state: str
    out: str
    #: (state or None, now, event) -> (state or None, output row or None)
    step: Callable[[tuple | None, int, dict], tuple[tuple | None, tuple | None]]
    #: The time at which something in the state lapses, if any does.
    due: Callable[[tuple], int | None] = lambda state: None
    #: What is left of a state after that, and an output row, if it says something.
    lapse: Callable[[tuple], tuple[tuple | None, tuple | None]] = lambda state: (state, None)


def session(spark: SparkSession) -> SparkSession:
    """A session of its own (same context) with the state store that timers need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key
        self.columns = [c.split()[0] for c in f"{key} _, {fold.out}".split(",")]

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.fold.state}, clock long, timer long")

    def _load(self) -> tuple[tuple | None, int, int]:
        row = self.kept.get()
        return (None, 0, 0) if row is None else (tuple(row[:-2]), row[-2], row[-1])

    def _save(self, state: tuple | None, clock: int, timer: int) -> None:
        due = self.fold.due(state) if state is not None else None
        wanted = -(-due // 1000) if due else 0
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update((*state, clock, wanted))

    def _lapsed(self, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        while state is not None and (due := self.fold.due(state)) and due <= now:
            state, row = self.fold.lapse(state)
            if row is not None:
                out.append(row)
        return state

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=self.columns).astype(object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, clock, timer = self._load()
        events = pd.concat(list(rows)).sort_values(["event_us", "event_id"], kind="stable")
        out: list[tuple] = []
        for event in events.to_dict("records"):
            clock = max(clock, event["event_us"])
            state = self._lapsed(state, clock, out)
            state, row = self.fold.step(state, clock, event)
            if row is not None:
                out.append(row)
        self._save(state, clock, timer)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, clock, _ = self._load()
        out: list[tuple] = []
        state = self._lapsed(state, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._save(state, clock, 0)  # this timer has gone
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, key: str = "user_id", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(key, the fold's output) of a stream of events with event_id, ``ts`` and what the fold reads."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withColumn("event_us", F.unix_micros(ts)).withWatermark(ts, late)
    return timed.groupBy(key).transformWithStateInPandas(_Processor(fold, key), f"{key} {kind}, {fold.out}", "Append", "EventTime")


def one_time_codes(ttl: float = 300, resend: float = 60) -> Fold:
    """Codes that lapse, and a lock on sending another.

    Events: ``action`` ('request' or else a try) and ``code``.  A request is
    'locked' for ``resend`` seconds after one that was 'sent'; a try is
    'accepted' once, within ``ttl`` seconds of the latest sent code, and
    'refused' otherwise.  A code that nobody used gives its request once more
    as 'lapsed'.
    """

    def step(state, now, event):
        code, sent, until, lock = state or (None, None, 0, 0)
        if event["action"] == "request":
            if lock > now:
                return state, (event["event_id"], "locked")
            return (event["code"], event["event_id"], now + int(ttl * SECOND), now + int(resend * SECOND)), (event["event_id"], "sent")
        if sent is None or code is None or code != (event["code"] or "").strip():
            return state, (event["event_id"], "refused")
        return (None, None, 0, lock), (event["event_id"], "accepted")

    def due(state):
        return state[2] if state[1] is not None else state[3]

    def lapse(state):
        _, sent, until, lock = state
        if sent is None:
            return None, None
        return ((None, None, 0, lock) if lock > until else None), (sent, "lapsed")

    return Fold("code string, sent long, until long, lock long", "event_id long, outcome string", step, due, lapse)


def route_cooldowns(unit: float = 5, most: float = 60, cap: int = 10, keep: float = 0.7) -> Fold:
    """Failures, smoothed latency and cooldown of each route.

    Events: ``ok`` and ``latency``.  A failure cools its route for
    min(most, unit x failures) seconds, failures count up to ``cap``; a
    success takes one failure off, ends the cooldown and moves the latency.
    ``cooling``: the event met a cooled route.  A cooldown that runs out gives
    the failure's event once more, as 'open'.
    """

    def step(state, now, event):
        failures, until, latency, last = state or (0, 0, None, None)
        cooling = until > now
        if event["ok"]:
            value = max(0.0, float(event["latency"]))
            latency = value if latency is None else latency * keep + value * (1 - keep)
            failures, until, last = max(0, failures - 1), 0, None
        else:
            failures = min(cap, failures + 1)
            until, last = now + int(min(most, unit * failures) * SECOND), event["event_id"]
        return (failures, until, latency, last), (event["event_id"], "ok" if event["ok"] else "failed", cooling, failures, latency)

    def due(state):
        return state[1] or None

    def lapse(state):
        failures, _, latency, last = state
        return (failures, 0, latency, None), (last, "open", False, failures, latency)

    return Fold("failures int, until long, latency double, last long", "event_id long, outcome string, cooling boolean, failures int, latency double", step, due, lapse)


def adaptive_limits(most: int = 6, least: int = 2, streak: int = 6, slow: float = 20_000) -> Fold:
    """Concurrency after each event: one down at a failure, one up after ``streak`` fast successes in a row.

    Events: ``ok`` and ``latency``; a slow success only ends the streak.
    """

    def step(state, now, event):
        limit, run, lowest, downs, ups = state or (most, 0, most, 0, 0)
        if not event["ok"]:
            run = 0
            if limit > least:
                limit, downs = limit - 1, downs + 1
                lowest = min(lowest, limit)
        elif event["latency"] > slow:
            run = 0
        else:
            run += 1
            if run >= streak:
                run = 0
                if limit < most:
                    limit, ups = limit + 1, ups + 1
        return (limit, run, lowest, downs, ups), (event["event_id"], limit, lowest, downs, ups)

    return Fold("current int, run int, lowest int, downs int, ups int", "event_id long, current int, lowest int, downs int, ups int", step)


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all there is, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/quirefold-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

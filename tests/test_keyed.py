"""Keyed state with lapses: restarts, late rows and quiet keys against plain simulations."""

import datetime

import pytest

from quirefold.plans import stream_queries
from quirefold.streaming import keyed

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, action string, code string, ok boolean, latency double"


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def run(spark, folder, fold, batches, late="0 seconds"):
    """One run over each batch, all with one checkpoint: every run is a restart."""
    own = keyed.session(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        events = own.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
        out = keyed.folded(events, fold, late=late)
        q = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    return spark.read.parquet(f"{folder}/rows").collect()


def requests():
    """(user, second, action, code): deterministic, dense enough for every outcome."""
    rows, x = [], 7
    for s in range(0, 3000, 5):
        x = (x * 1103515245 + 12345) % 2**31
        user, kind = x % 5, (x >> 8) % 4
        rows.append((user, s + (x >> 12) % 5 * 0.25, "request" if kind < 2 else "try", f" c{user} " if kind == 2 else f"c{user}" if kind < 2 else "no"))
    return rows


def store(rows, ttl, resend):
    """The same on a dictionary with expiry times."""
    codes, locks, out = {}, {}, []
    for i, (u, s, action, code) in enumerate(rows):
        for v in [v for v, c in codes.items() if c[2] <= s]:
            out.append((v, codes.pop(v)[1], "lapsed"))
        if action == "request":
            if locks.get(u, -1) > s:
                out.append((u, i, "locked"))
            else:
                codes[u], locks[u] = (code, i, s + ttl), s + resend
                out.append((u, i, "sent"))
        elif u in codes and codes[u][0] == code.strip():
            del codes[u]
            out.append((u, i, "accepted"))
        else:
            out.append((u, i, "refused"))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_codes_restart(spark, tmp_path, parts):
    rows = requests()
    rows.append((99, 90_000.0, "try", "x"))  # moves the watermark past everything
    events = [(u, i, at(s), a, c, None, None) for i, (u, s, a, c) in enumerate(rows)]
    size = -(-len(events) // parts)
    got = run(spark, tmp_path, keyed.one_time_codes(40, 12), [events[k : k + size] for k in range(0, len(events), size)])
    want = store(rows, 40, 12)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.outcome for r in got} == {"sent", "locked", "accepted", "refused", "lapsed"}


def test_late_rows_and_quiet_keys(spark, tmp_path):
    first = [(1, 0, at(100), "request", "a", None, None), (2, 1, at(101), "request", "b", None, None), (None, 2, at(102), "request", "n", None, None), (3, 3, None, "request", "t", None, None)]
    # a late try counts at the key's clock; key 2 stays quiet and lapses by its timer
    second = [(1, 4, at(99), "try", "a", None, None), (1, 5, at(99), "try", "a", None, None), (5, 6, at(1000), "try", "x", None, None)]
    got = run(spark, tmp_path, keyed.one_time_codes(30, 10), [first, second], late="60 seconds")
    by = {(r.event_id, r.outcome) for r in got}
    assert by == {(0, "sent"), (1, "sent"), (2, "sent"), (4, "accepted"), (5, "refused"), (6, "refused"), (1, "lapsed"), (2, "lapsed")}


def test_cooldowns(spark, tmp_path):
    e = lambda i, s, ok, ms=100.0: (1, i, at(s), None, None, ok, ms)
    batches = [[e(0, 0, False), e(1, 4, False), e(2, 13, True, 50.0)], [e(3, 20, False), e(4, 26, False), e(5, 100, True, 200.0)]]
    got = {(r.event_id, r.outcome): (r.cooling, r.failures, r.latency) for r in run(spark, tmp_path, keyed.route_cooldowns(), batches)}
    assert got == {
        (0, "failed"): (False, 1, None), (1, "failed"): (True, 2, None), (2, "ok"): (True, 1, 50.0),
        (3, "failed"): (False, 2, 50.0), (4, "failed"): (True, 3, 50.0), (4, "open"): (False, 3, 50.0), (5, "ok"): (False, 2, 50.0 * 0.7 + 200.0 * (1 - 0.7)),
    }
    fold = keyed.route_cooldowns()
    state = None
    for i in range(15):
        state, row = fold.step(state, i, {"event_id": i, "ok": False, "latency": 1.0})
    assert state[0] == 10 and state[1] == 14 + 50 * keyed.SECOND


def test_limits(spark, tmp_path):
    outcomes = [True] * 6 + [False] * 6 + [True] * 5 + [None] + [True] * 13
    rows = [(1, i, at(i), None, None, ok is not False, 30_000.0 if ok is None else 10.0) for i, ok in enumerate(outcomes)]
    got = [r.current for r in sorted(run(spark, tmp_path, keyed.adaptive_limits(), [rows[:9], rows[9:]]), key=lambda r: r.event_id)]
    assert got == [6] * 6 + [5, 4, 3, 2, 2, 2] + [2] * 5 + [2] + [2] * 5 + [3] * 6 + [4] * 2


def test_state_goes(spark, tmp_path):
    """A key whose code and lock have lapsed keeps no state."""
    rows = [[(u, u, at(u), "request", "c", None, None) for u in range(50)], [(77, 99, at(5000), "try", "x", None, None)], [(77, 100, at(9000), "try", "x", None, None)]]
    got = run(spark, tmp_path, keyed.one_time_codes(30, 10), rows)
    assert sum(r.outcome == "lapsed" for r in got) == 50
    own = keyed.session(spark)
    kept = own.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/state")
    assert kept.count() == 0


def test_queries_hold_every_outcome(spark):
    got = {r.outcome for r in stream_queries.stream_codes(spark, "/root/testdata/sf0.001").select("outcome").distinct().collect()}
    assert got == {"sent", "locked", "accepted", "refused", "lapsed"}

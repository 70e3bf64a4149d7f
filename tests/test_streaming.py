import shutil

from quirefold.streaming import stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def stream(spark, tmp_path):
    shutil.copy(EVENTS, tmp_path / "events.parquet")
    return spark.readStream.schema(spark.read.parquet(EVENTS).schema).parquet(str(tmp_path))


def test_daily_visits(spark, tmp_path):
    out = drain(stateful.daily_visits(stream(spark, tmp_path)), "visits", "complete")
    assert out.selectExpr("sum(pv)").first()[0] == spark.read.parquet(EVENTS).count()


def test_quota(spark, tmp_path):
    out = drain(stateful.quota(stream(spark, tmp_path)), "quota")
    batch = spark.read.parquet(EVENTS).selectExpr("event_id", "row_number() over (partition by user_id, to_date(ts) order by ts, event_id) <= 3 as allowed")
    assert sorted((r.event_id, r.allowed) for r in out.collect()) == sorted((r.event_id, r.allowed) for r in batch.collect())


def test_throttle_and_dedup(spark, tmp_path):
    s = stream(spark, tmp_path)
    out = drain(stateful.throttled(s, 3600.0), "throttled").collect()
    by = {}
    for r in sorted(out, key=lambda r: r.ts):
        assert r.user_id not in by or (r.ts - by[r.user_id]).total_seconds() >= 3600
        by[r.user_id] = r.ts
    assert drain(stateful.distinct_events(s), "distinct_events").count() == spark.read.parquet(EVENTS).select("event_id").distinct().count()


def test_fence(spark, tmp_path):
    write = stateful.fenced_sink(f"{tmp_path}/out", lambda: spark.createDataFrame([(1, "b")], "job_id int, attempt_id string"))
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 3)], "job_id int, attempt_id string, v int")
    write(batch, 0)
    write(batch, 0)
    assert [r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]

import datetime
import random

from citeloom.streaming import breaker


def test_breaker_steps():
    s = {"mode": "closed", "opened": 0.0, "failed": []}
    for t in range(5):
        assert breaker.step(s, t, False)[0]
    assert s["mode"] == "open"
    assert breaker.step(s, 10, True) == (False, "open")
    assert breaker.step(s, 34.5, False) == (True, "open")  # the probe fails
    assert breaker.step(s, 60, True) == (False, "open")
    assert breaker.step(s, 65, True) == (True, "closed")
    assert breaker.step(s, 66, False) == (True, "closed")


def test_window_against_counting(spark, rows):
    r = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    data = [(k, start + datetime.timedelta(seconds=r.randint(0, 20_000)), r.choice(["error", "click"])) for k in range(400)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, event_type string")
    errors = [(k, t) for k, t, e in data if e == "error"]
    want = sorted((k, n) for k, t in errors if (n := sum(0 <= (t - u).total_seconds() <= 600 for _, u in errors)) >= 4)
    assert rows(breaker.tripping(df, 600, 4, bucket=1000)) == sorted(want, key=repr)
    assert breaker.tripping(df.limit(0), 600, 4).count() == 0


def test_stateful_stream(spark, tmp_path):
    calls = [("r", float(t), False) for t in range(6)] + [("r", 50.0, True), ("q", 1.0, True)]
    spark.createDataFrame(calls, "registry string, ts double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("registry string, ts double, ok boolean").parquet(str(tmp_path / "in"))
    q = breaker.stateful(stream).writeStream.format("memory").queryName("calls_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted((r.registry, r.ts, r.admitted, r.mode) for r in spark.sql("SELECT * FROM calls_out").collect())
    assert got[0] == ("q", 1.0, True, "closed")
    assert [(a, m) for _, _, a, m in got[1:]] == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (True, "closed")]


def test_seen_ids(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t)], "id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = breaker.unseen(stream, "id", "ts").writeStream.format("memory").queryName("unseen_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.id for r in spark.sql("SELECT id FROM unseen_out").collect()) == [1, 2]


def test_cache_stream(spark, tmp_path):
    from citeloom.streaming import cache

    calls = [("k", 0.0), ("k", 5.0), ("k", 11.0), ("k", 12.0), ("j", 3.0)]
    spark.createDataFrame(calls, "key string, ts double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts double").parquet(str(tmp_path / "in"))
    q = cache.lookups(stream, 10.0).writeStream.format("memory").queryName("cache_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted((r.key, r.ts, r.hit) for r in spark.sql("SELECT * FROM cache_out").collect())
    assert got == [("j", 3.0, False), ("k", 0.0, False), ("k", 5.0, True), ("k", 11.0, False), ("k", 12.0, True)]


def test_replay_goes_on_after_midnight(spark, rows, tmp_path):
    calls = [("2024-01-01 23:50:00", "error", "a"), ("2024-01-02 00:10:00", "error", "a"), ("2024-01-02 00:20:00", "view", "a"), ("2024-01-02 00:20:00", "view", "b")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(calls)], "event_id long, ts string, event_type string, props string")
    df.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "event_type", "props").write.parquet(str(tmp_path / "events.parquet"))
    assert rows(breaker.replay(spark, str(tmp_path)), "mode", "admitted", "n") == [("closed", True, 2), ("open", False, 1), ("open", True, 1)]


def test_calls_of_one_trigger_are_put_in_order(spark, tmp_path):
    """More calls than an Arrow batch holds, handed over in no order, are folded in time order."""
    calls = [("r", float(t), t >= 40) for t in range(60)]
    random.Random(3).shuffle(calls)
    spark.createDataFrame(calls, "registry string, ts double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema("registry string, ts double, ok boolean").parquet(str(tmp_path / "in"))
        q = breaker.stateful(stream).writeStream.format("memory").queryName("ordered_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state = {"mode": "closed", "opened": 0.0, "failed": []}
    want = [(t, *breaker.step(state, t, ok)) for _, t, ok in sorted(calls, key=lambda c: c[1])]
    got = sorted((r.ts, r.admitted, r.mode) for r in spark.sql("SELECT * FROM ordered_out").collect())
    assert got == want
    s = breaker.statistics(spark.sql("SELECT * FROM ordered_out")).first()
    assert (s.calls, s.rejected) == (60, sum(not a for _, a, _ in want))


def test_cache_forgets_the_longest_unused():
    from collections import OrderedDict

    from citeloom.streaming.cache import touch

    e = OrderedDict()
    ask = lambda k, t, found=True: touch(e, k, t, found, 100.0, 10.0, 2)
    assert not ask("a", 0) and not ask("b", 1) and ask("a", 2)
    assert not ask("c", 3) and list(e) == ["a", "c"]  # b was unused longest
    assert not ask("b", 4) and not ask("a", 5)
    assert not ask("x", 6, False) and ask("x", 15, False) and not ask("x", 17, False)
    assert not ask("b", 200)

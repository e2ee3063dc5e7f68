"""The circuit breaker of calls to a registry, in batch and as a stateful stream, and a seen-id filter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.session import table

# Failures that open a breaker, the seconds they fall in, and until a probe is let through.
FAILURES, SECONDS, REST = 5, 60.0, 30.0


def tripping(events: DataFrame, seconds: int = int(SECONDS), failures: int = FAILURES, bucket: int | None = None) -> DataFrame:
    """(event_id, failures): error events with at least `failures` errors in the time up to them.

    A window over all events would be one task. Time is cut into buckets of the window's
    length; each error is also handed to the next bucket, where it can only be counted.
    """
    width = bucket or max(seconds, 1) * 24
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.where("event_type = 'error'").select("event_id", us.alias("t"))
    home = F.floor(F.col("t") / (width * 1_000_000))
    late = F.pmod(F.col("t"), F.lit(width * 1_000_000)) >= (width - seconds) * 1_000_000 - 1
    dealt = e.select("event_id", "t", home.alias("home"), F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("b"))
    w = W.partitionBy("b").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    counted = dealt.withColumn("failures", F.count("*").over(w))
    return counted.where((F.col("home") == F.col("b")) & (F.col("failures") >= failures)).select("event_id", "failures")


def step(state: dict[str, Any], ts: float, ok: bool, failures: int = FAILURES, seconds: float = SECONDS, rest: float = REST) -> tuple[bool, str]:
    """One call against a breaker's state: whether it is let through, and the state after it.

    closed: failures of the last `seconds` are held, enough of them open it. open: nothing
    passes for `rest` seconds, then one probe does; it closes the breaker or opens it anew.
    """
    if state["mode"] == "open":
        if ts - state["opened"] < rest:
            return False, "open"
        state["mode"] = "probe"
    if state["mode"] == "probe":
        state["mode"], state["failed"] = ("closed", []) if ok else ("open", state["failed"])
        if not ok:
            state["opened"] = ts
        return True, state["mode"]
    if not ok:
        state["failed"] = [t for t in state["failed"] if t > ts - seconds] + [ts]
        if len(state["failed"]) >= failures:
            state["mode"], state["opened"] = "open", ts
    return True, state["mode"]


def stateful(calls: DataFrame, failures: int = FAILURES, seconds: float = SECONDS, rest: float = REST, idle_ms: int | None = None) -> DataFrame:
    """(registry, ts, admitted, mode) of a stream (registry, ts, ok); state is kept per registry.

    A registry's calls of one trigger are put in order together, however many Arrow batches
    they come in; the trigger bounds them. No more failures are kept than open the breaker,
    and a registry without a call for idle_ms is forgotten, which is the closed state. With
    idle_ms a query never rests, for it has to watch the clock; leave it out for finite input.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        mode, opened, failed = held.get if held.exists else ("closed", 0.0, [])
        state = {"mode": mode, "opened": opened, "failed": list(failed)}
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        times = rows.ts.astype("int64") / 1e9 if rows.ts.dtype.kind == "M" else rows.ts
        out = [step(state, t, bool(ok), failures, seconds, rest) for t, ok in zip(times, rows.ok)]
        held.update((state["mode"], state["opened"], state["failed"][-failures:]))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"registry": key[0], "ts": rows.ts.to_numpy(), "admitted": [a for a, _ in out], "mode": [m for _, m in out]})

    return calls.groupBy("registry").applyInPandasWithState(run, "registry string, ts double, admitted boolean, mode string", "mode string, opened double, failed array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def statistics(answered: DataFrame) -> DataFrame:
    """(registry, calls, rejected, opened, rejection_rate) of answered calls (registry, ts, admitted, mode)."""
    g = answered.groupBy("registry").agg(F.count("*").alias("calls"), F.count_if(~F.col("admitted")).alias("rejected"), F.count_if(F.col("admitted") & (F.col("mode") == "open")).alias("opened"))
    return g.withColumn("rejection_rate", F.round(F.col("rejected") / F.col("calls"), 6))


def unseen(stream: DataFrame, key: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key in a stream, as long as its watermark remembers the key."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def replay(spark: SparkSession, d: str) -> DataFrame:
    """(mode, admitted, n): all events as calls through one breaker per registry, which props name, by the batch twin of the stream.

    Each registry's calls are sorted by time and read in batches; the state goes on from
    batch to batch, so nothing is forgotten at midnight and no task holds a whole registry.
    """
    calls = table(spark, d, "events").select(F.col("props").alias("registry"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("event_type") != "error").alias("ok"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry, state = object(), {}
        for rows in batches:
            out = []
            for r, t, ok in zip(rows.registry, rows.us, rows.ok):
                if r != registry:
                    registry, state = r, {"mode": "closed", "opened": 0.0, "failed": []}
                out.append(step(state, t / 1e6, bool(ok), 2, 86400.0, 3600.0))
            yield pd.DataFrame(out, columns=["admitted", "mode"])

    ordered = calls.repartition("registry").sortWithinPartitions("registry", "us", "event_id").select("registry", "us", "ok")
    folded = ordered.mapInPandas(run, "admitted boolean, mode string")
    return folded.groupBy("mode", "admitted").agg(F.count("*").alias("n"))

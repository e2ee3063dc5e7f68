"""A cache whose entries live for a time and of which the longest unused goes first, as keyed state of a stream."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def touch(entries: OrderedDict, key: str, ts: float, found: bool, ttl: float, ttl_missing: float, capacity: int) -> bool:
    """One call: whether a live entry answers it. A miss puts the entry, and the longest unused goes where there are too many.

    What was not found lives for ttl_missing. A hit does not prolong an entry's life.
    """
    held = entries.get(key)
    if held is not None and ts - held[0] <= (ttl if held[1] else ttl_missing):
        entries.move_to_end(key)
        return True
    entries[key] = (ts, found)
    entries.move_to_end(key)
    while len(entries) > capacity:
        entries.popitem(last=False)
    return False


def lookups(calls: DataFrame, ttl: float, ttl_missing: float | None = None, capacity: int = 10_000, shards: int = 16, idle_ms: int | None = None) -> DataFrame:
    """(key, ts, hit) of a stream (key, ts[, found]): whether an entry put `ttl` seconds ago or later is there.

    Keys are dealt to shards, each with its part of the capacity, so state is bounded by the
    capacity whatever the number of keys; a shard without a call for idle_ms, where given, is forgotten.
    A shard's calls of one trigger are put in order together.
    """
    each, short = max(1, capacity // shards), ttl if ttl_missing is None else ttl_missing
    found = F.col("found") if "found" in calls.columns else F.lit(True)
    dealt = calls.select("key", F.col("ts").cast("double").alias("ts"), found.alias("found"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        entries = OrderedDict((k, (p, f)) for k, p, f in zip(*held.get)) if held.exists else OrderedDict()
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        hits = [touch(entries, k, float(t), bool(f), ttl, short, each) for k, t, f in zip(rows.key, rows.ts, rows.found)]
        held.update((list(entries), [p for p, _ in entries.values()], [f for _, f in entries.values()]))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": rows.key.to_numpy(), "ts": rows.ts.to_numpy(), "hit": hits})

    return dealt.groupBy("shard").applyInPandasWithState(run, "key string, ts double, hit boolean", "keys array<string>, put array<double>, found array<boolean>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)

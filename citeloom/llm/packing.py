"""Filling containers of fixed capacity by linear grouping.

Sizes are counted into a histogram (no more than `capacity` different sizes, so it is
small at any number of documents). Large sizes are cut into groups of equal cardinality
and rounded up to the largest of their group; the few rounded sizes are packed by
configurations, each of which is the best filling for the demand that is left. Documents
take the places of the rounded sizes by their rank in the group, found with counts per
bucket and not with one global sort. Small documents then go best-fit into what is left,
shard by shard. A document above the capacity is cut at multiples of the capacity: the
full pieces fill a container each, the rest is packed like a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.session import cut

CONTAINERS = "spec_id int, container_id string, doc_id long, part_no int, token_start long, token_end long"
#: items of at most this share of the capacity count as small
SMALL_SHARE = 0.15
#: rounded sizes for the large items of one capacity
GROUPS = 24
#: small items that one best-fit task gets, about
SHARD = 20_000
#: the ranks of one group are found in buckets of about so many items
BUCKET_ITEMS = 100_000


def byte_tokens(text: Column) -> Column:
    """Size in tokens of the public byte tokenizer: the UTF-8 bytes and one end token."""
    return F.octet_length(text).cast("long") + 1


def group_sizes(sizes: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """For each of the rising sizes the number of its group; groups have about equal counts."""
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) + counts / 2
    return np.minimum((before * groups / max(1, counts.sum())).astype(int), groups - 1)


def best_filling(sizes: list[int], left: list[int], capacity: int, grain: int) -> list[int]:
    """How many of each size fill the capacity best, using no more than are left."""
    room = capacity // grain
    best = np.zeros(room + 1, dtype=np.int64)
    took: list[tuple[int, int, np.ndarray]] = []
    for k, (size, have) in enumerate(zip(sizes, left)):
        need = -(-size // grain)
        most, step = min(have, capacity // size), 1
        while most > 0:  # multiples of 1, 2, 4, ... make every number up to `most`
            n = min(step, most)
            most -= n
            step *= 2
            w = n * need
            if w > room:
                continue
            with_it = np.full(room + 1, -1, dtype=np.int64)
            with_it[w:] = best[: room + 1 - w] + n * size
            better = with_it > best
            best = np.where(better, with_it, best)
            took.append((k, n, better))
    out, at = [0] * len(sizes), room
    for k, n, better in reversed(took):
        if better[at]:
            out[k] += n
            at -= n * -(-sizes[k] // grain)
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings with the number of containers each is used for, until all demand is met."""
    left, out, grain = list(demand), [], max(1, capacity // 4096)
    while any(left):
        first = max((k for k, n in enumerate(left) if n), key=lambda k: sizes[k])
        rest = [n - (k == first) for k, n in enumerate(left)]
        filling = best_filling(sizes, rest, capacity - sizes[first], grain) if capacity - sizes[first] >= grain else [0] * len(sizes)
        filling[first] += 1
        times = min(left[k] // n for k, n in enumerate(filling) if n)
        out.append((filling, times))
        left = [n - times * m for n, m in zip(left, filling)]
    return out


def plan(histogram: list[tuple[int, int]], capacity: int, small: float = SMALL_SHARE, groups: int = GROUPS) -> dict:
    """Where the r-th document of each group goes.

    histogram: (size, count) pairs of the items of at most the capacity. Gives for each
    smallest sizes of all groups in rising order and for each group the rows (first rank,
    first container, copies per container); containers are counted from 0.
    """
    large = sorted((s, n) for s, n in histogram if s > small * capacity)
    least: list[int] = []
    slots: dict[int, list[tuple[int, int, int]]] = {}
    containers = 0
    if large:
        sizes, counts = np.array([s for s, _ in large]), np.array([n for _, n in large])
        group = group_sizes(sizes, counts, groups)
        names = sorted(set(group.tolist()))
        group = np.searchsorted(names, group)
        names = list(range(len(names)))
        least = [int(sizes[group == g].min()) for g in names]
        rounded = [int(sizes[group == g].max()) for g in names]
        filled = [0] * len(names)
        for filling, times in configurations(rounded, [int(counts[group == g].sum()) for g in names], capacity):
            for k, n in enumerate(filling):
                if n:
                    slots.setdefault(names[k], []).append((filled[k], containers, n))
                    filled[k] += n * times
            containers += times
    return {"least": least, "slots": {g: tuple(np.array(x) for x in zip(*rows)) for g, rows in slots.items()}, "containers": containers}


def best_fit(room: list[tuple[str, int]], sizes: np.ndarray, capacity: int, name: str) -> list[str]:
    """The container of each small item, largest first; new ones are opened where none fits."""
    import bisect

    free = sorted((r, c) for c, r in room)
    out, opened = [""] * len(sizes), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, ""))
        if at == len(free):
            c, r = f"{name}-{opened}", capacity
            opened += 1
        else:
            r, c = free.pop(at)
        out[i] = c
        if r - size > 0:
            bisect.insort(free, (r - size, c))
    return out


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(spec_id, container_id, doc_id, part_no, token_start, token_end): all filled containers.

    Every document of every spec is in one container, or in several pieces where it alone
    exceeds the capacity. Null texts take no room and give no row; empty texts have size 1;
    equal texts and repeated ids are packed each. No specs or no documents give an empty
    result. Specs are few: one row per container size, read by the driver.
    """
    spark = docs.sparkSession
    wanted = sorted({(int(r.spec_id), int(r.capacity)) for r in specs.where("spec_id IS NOT NULL AND capacity > 0").select("spec_id", "capacity").collect()})
    if not wanted:
        return spark.createDataFrame([], CONTAINERS)
    # the texts are read once; from here on there are ids and sizes
    sized = cut(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), byte_tokens(F.col(text_col)).alias("size")))
    spec = F.explode(F.array(*(F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for i, c in wanted)))
    each = sized.select("doc_id", "size", spec.alias("s")).select("doc_id", "size", "s.*")
    over = F.col("size") > F.col("capacity")
    pieces = F.when(over, F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("capacity")))).otherwise(F.array(F.lit(0).cast("long")))
    items = each.select("spec_id", "capacity", "doc_id", "size", F.explode(pieces).alias("piece"))
    items = items.select(
        "spec_id", "capacity", "doc_id", F.col("piece").cast("int").alias("part_no"), (F.col("piece") * F.col("capacity")).alias("token_start"),
        F.least(F.col("size"), (F.col("piece") + 1) * F.col("capacity")).alias("token_end"),
    )
    items = items.withColumn("length", F.col("token_end") - F.col("token_start"))
    # at most `capacity` different sizes for each spec, whatever the number of documents
    sizes = items.groupBy("spec_id", "length").count().toPandas()
    plans = {i: plan(list(zip(h["length"].tolist(), h["count"].tolist())), c) for i, c in wanted for h in [sizes[sizes.spec_id == i]]}
    buckets = max(1, int(sizes["count"].sum()) // (BUCKET_ITEMS * GROUPS))
    by_spec = lambda value: F.coalesce(*(F.when(F.col("spec_id") == i, value(p)) for i, p in plans.items()))
    # the number of groups that begin at or below the length; -1 for small items
    number = by_spec(lambda p: sum((F.col("length") >= x).cast("int") for x in p["least"]) - 1 if p["least"] else F.lit(-1))
    grouped = items.withColumn("group_no", number).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(buckets)).cast("int"))
    # the rank of a document in its group: its place in the bucket and the counts of the buckets before
    per = grouped.where("group_no >= 0").groupBy("spec_id", "group_no", "bucket").agg(F.count("*").alias("n"))
    before = per.select("spec_id", "group_no", "bucket", (F.sum("n").over(W.partitionBy("spec_id", "group_no").orderBy("bucket")) - F.col("n")).alias("before"))
    places = spark.sparkContext.broadcast({i: p["slots"] for i, p in plans.items()})  # a few rows for each group

    def place(rows: pd.DataFrame, first_rank: pd.DataFrame) -> pd.DataFrame:
        i, g = int(rows.spec_id.iloc[0]), int(rows.group_no.iloc[0])
        first, container, copies = places.value[i][g]
        rows = rows.sort_values(["length", "doc_id", "part_no"], ascending=[False, True, True])
        rank = int(first_rank.before.iloc[0]) + np.arange(len(rows))
        at = np.searchsorted(first, rank, side="right") - 1
        rows["container_no"] = container[at] + (rank - first[at]) // copies[at]
        return rows[["spec_id", "capacity", "doc_id", "part_no", "token_start", "token_end", "length", "container_no"]]

    cols = "spec_id int, capacity long, doc_id long, part_no int, token_start long, token_end long, length long"
    key = ["spec_id", "group_no", "bucket"]
    large = cut(grouped.where("group_no >= 0").groupBy(*key).cogroup(before.groupBy(*key)).applyInPandas(place, f"{cols}, container_no long"))
    count_small = {int(i): int(sizes[(sizes.spec_id == i) & (sizes.length < (plans[i]["least"] or [1 << 62])[0])]["count"].sum()) for i, _ in wanted}
    # room left in the containers of large items, and the small items, dealt out to shards
    shards = F.coalesce(*(F.when(F.col("spec_id") == i, F.lit(max(1, -(-count_small[i] // shard), -(-plans[i]["containers"] // (2 * shard))))) for i, _ in wanted))
    deal = lambda *c: F.pmod(F.xxhash64(*c), shards).cast("int")
    room = large.groupBy("spec_id", "capacity", "container_no").agg(F.sum("length").alias("used")).where("used < capacity")
    room = room.select("spec_id", "capacity", deal("container_no").alias("shard_no"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("part_no"), F.lit(None).cast("long").alias("token_start"), F.lit(None).cast("long").alias("token_end"), (F.col("capacity") - F.col("used")).alias("length"), "container_no")
    small = grouped.where("group_no < 0").select("spec_id", "capacity", deal("doc_id", "part_no").alias("shard_no"), "doc_id", "part_no", "token_start", "token_end", "length", F.lit(None).cast("long").alias("container_no"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spec_id, shard_no, capacity = int(key[0]), int(key[1]), int(rows.capacity.iloc[0])
        open_, items = rows[rows.doc_id.isna()], rows[rows.doc_id.notna()].sort_values(["doc_id", "part_no"])
        at = best_fit([(f"L{int(c)}", int(r)) for c, r in zip(open_.container_no, open_.length)], items.length.to_numpy(), capacity, f"S{shard_no}")
        number = {c: items[c].to_numpy(dtype=np.int64) for c in ("doc_id", "part_no", "token_start", "token_end")}
        # a shard may hold open containers only
        return pd.DataFrame({"spec_id": np.full(len(items), spec_id), "container_id": np.array(at, dtype=object), **number})

    filled = room.unionByName(small).groupBy("spec_id", "shard_no").applyInPandas(fill, CONTAINERS)
    placed = large.select("spec_id", F.concat(F.lit("L"), "container_no").alias("container_id"), "doc_id", "part_no", "token_start", "token_end")
    return placed.unionByName(filled)


def oversized(packed: DataFrame) -> DataFrame:
    """(spec_id, doc_id) of the documents that a packing holds in several pieces."""
    return packed.where("part_no > 0").select("spec_id", "doc_id").distinct()


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill): how full the containers of each spec are."""
    used = packed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    return used.join(specs.select("spec_id", "capacity"), "spec_id").select("spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))

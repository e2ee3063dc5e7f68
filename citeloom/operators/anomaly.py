"""Detectors over a citation graph and the health of a graph.

nodes: (id, year, authors, counts) with the surnames of the authors; edges: (src, dst), a
multiset. Every detector gives rows (anomaly, node, severity, score), so that they union.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators import graph

# Signal of each kind of anomaly, and confidence of a severity.
SIGNAL = {
    "self_citation_ring": "citation_ring_detected", "excessive_self_citation": "excessive_self_citation", "temporal_anomaly": "temporal_anomaly", "orphan_cluster": "orphan_cluster", "benford_violation": "benford_violation",
    "reciprocal_citation": "reciprocal_citation", "citation_burst": "citation_burst",
}
SEVERITY = {"critical": 1.0, "high": 0.85, "medium": 0.6, "low": 0.3}
# What each part of the health score weighs.
HEALTH = {"interconnection": 0.25, "temporal": 0.25, "self_citation": 0.20, "benford": 0.15, "reciprocal": 0.15}


def _rows(df: DataFrame, name: str, node: Column, severity: Column, score: Column) -> DataFrame:
    return df.select(F.lit(name).alias("anomaly"), node.cast("string").alias("node"), severity.alias("severity"), F.round(score, 6).alias("score"))


def orphan_clusters(edges: DataFrame, threshold: float = 0.05, least: int = 5) -> DataFrame:
    """Nodes whose references hardly point to one another."""
    d = graph.densities(edges, least).where(F.col("density") < threshold)
    return _rows(d, "orphan_cluster", F.col("src"), F.when(F.col("density") < 0.01, "high").otherwise("medium"), 1 - F.col("density") / threshold)


def temporal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Citations of something later, by their source."""
    year = nodes.select("id", "year").where("year > 0")
    e = edges.join(year.toDF("src", "src_year"), "src").join(year.toDF("dst", "dst_year"), "dst")
    t = graph.temporal(e)
    return _rows(t, "temporal_anomaly", F.col("src"), F.col("severity"), F.col("score"))


def self_citation(nodes: DataFrame, edges: DataFrame, threshold: float = 0.3, least: int = 5) -> DataFrame:
    """Nodes that cite their own authors' works more often than threshold."""
    a = nodes.select("id", "authors")
    e = edges.join(a.toDF("src", "mine"), "src").join(a.toDF("dst", "theirs"), "dst", "left")
    shared = F.coalesce(F.arrays_overlap("mine", "theirs"), F.lit(False))
    g = e.where(F.size("mine") > 0).groupBy("src").agg(F.count("*").alias("refs"), F.avg(shared.cast("double")).alias("rate")).where((F.col("refs") >= least) & (F.col("rate") > threshold))
    return _rows(g, "excessive_self_citation", F.col("src"), F.when(F.col("rate") > 0.5, "high").otherwise("medium"), F.least((F.col("rate") - threshold) / (1 - threshold), F.lit(1.0)))


def grow_rings(pairs: list[tuple], least: int = 3, most: int = 10) -> list[tuple]:
    """Groups of nodes that cite one another: from each node on, the candidate tied to most of the group joins.

    Candidates stay tied to every member; ties go to the smallest id.
    """
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rings = set()
    for start in sorted(near):
        ring, open_ = {start}, set(near[start])
        while open_ and len(ring) < most:
            nearest = min(open_, key=lambda c: (-len(near[c] & ring), c))
            if len(near[nearest] & ring) * 2 < len(ring):
                break
            ring.add(nearest)
            open_ = (open_ & near[nearest]) - {nearest}
        if len(ring) >= least:
            rings.add(tuple(sorted(ring)))
    return sorted(rings)


def rings(edges: DataFrame) -> DataFrame:
    """(ring_id, node): groups of at least three nodes that cite one another.

    Grown inside each connected group of mutual pairs, which are far fewer than edges.
    """
    m = graph.mutual(edges).select("a", "b")
    roots = graph.components(m.toDF("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = grow_rings(list(zip(rows.a, rows.b)))
        return pd.DataFrame([(f"{r[0]}/{len(r)}/{k}", n) for k, r in enumerate(found) for n in r], columns=["ring_id", "node"])

    return m.join(roots.withColumnRenamed("id", "a"), "a").groupBy("component").applyInPandas(run, f"ring_id string, node {kind}")


def ring_rows(edges: DataFrame) -> DataFrame:
    """Rings as anomalies of their smallest node, by how densely they cite one another."""
    r = rings(edges)
    size = r.groupBy("ring_id").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    inner = r.select("ring_id", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").join(r.select("ring_id", F.col("node").alias("dst")), ["ring_id", "dst"]).groupBy("ring_id").agg(F.count("*").alias("k"))
    d = size.join(inner, "ring_id").withColumn("density", F.col("k") / (F.col("n") * (F.col("n") - 1)))
    return _rows(d, "self_citation_ring", F.col("node"), F.when(F.col("density") > 0.5, "critical").when(F.col("density") > 0.3, "high").otherwise("medium"), F.col("density"))


def reciprocal_authors(nodes: DataFrame, edges: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(a, b, ab, ba, ratio, severity, score): pairs of surnames that cite each other often and evenly."""
    names = lambda k: nodes.select(F.col("id").alias(k), F.explode("authors").alias(f"{k}_name"))
    e = edges.join(names("src"), "src").join(names("dst"), "dst").where("src_name <> dst_name").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    m = graph.mutual(e).where((F.col("ab") >= least) & (F.col("ba") >= least))
    total, ratio = F.col("ab") + F.col("ba"), F.least("ab", "ba") / F.greatest("ab", "ba")
    return m.where(ratio > share).select("a", "b", "ab", "ba", F.round(ratio, 6).alias("ratio"), F.when(total > 10, "high").otherwise("medium").alias("severity"), F.round(F.least(ratio * total / 20, F.lit(1.0)), 6).alias("score"))


def bursts(edges: DataFrame, by_year: DataFrame, factor: float = 3.0, share: float = 0.5, least: int = 3) -> DataFrame:
    """Nodes of five citations or more with a spike from one year to the next, or with few sources behind most of them.

    by_year: (dst, year, n) citations by year.
    """
    total = edges.groupBy("dst").agg(F.count("*").alias("total"), F.count_distinct("src").alias("sources")).where("total >= 5")
    w = W.partitionBy("dst").orderBy("year")
    steps = by_year.withColumn("before", F.lag("n").over(w)).where((F.col("before") > 0) & (F.col("n") > factor * F.col("before")))
    spike = steps.groupBy("dst").agg(F.min(F.struct("year", (F.col("n") / F.col("before")).alias("ratio"))).alias("s")).select("dst", F.col("s.ratio").alias("spike"))
    top = edges.groupBy("dst", "src").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(W.partitionBy("dst").orderBy(F.desc("k"), "src"))).where(F.col("r") <= least).groupBy("dst").agg(F.sum("k").alias("top"))
    j = total.join(top, "dst").join(spike, "dst", "left").withColumn("c", F.col("top") / F.col("total"))
    narrow = (F.col("c") > share) & (F.col("sources") >= least)
    score = F.greatest(F.coalesce(F.least((F.col("spike") - factor) / (factor * 2), F.lit(1.0)), F.lit(0.0)), F.when(narrow, F.least("c", F.lit(1.0))).otherwise(0.0))
    hit = j.where(narrow | F.col("spike").isNotNull()).withColumn("sc", score)
    return _rows(hit, "citation_burst", F.col("dst"), F.when(F.col("sc") > 0.7, "high").otherwise("medium"), F.col("sc"))


def benford(counts: DataFrame) -> DataFrame:
    """One row where the first digits of positive counts (n) of the whole graph deviate from their expected shares."""
    b = graph.benford(counts.select(F.lit("graph").alias("g"), F.col("n").cast("double").alias("n")), "n", "g").where("violated <> 'none'")
    return _rows(b, "benford_violation", F.col("g"), F.col("violated"), F.least(F.col("chi2") / (graph.CHI2_8[0] * 3), F.lit(1.0)))


def all_anomalies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(anomaly, node, severity, score) of all detectors."""
    years = edges.join(nodes.select(F.col("id").alias("src"), "year"), "src").where("year > 0").groupBy("dst", "year").agg(F.count("*").alias("n"))
    pairs = reciprocal_authors(nodes, edges)
    each = [
        orphan_clusters(edges), temporal(nodes, edges), self_citation(nodes, edges), ring_rows(edges), benford(edges.groupBy("dst").agg(F.count("*").alias("n"))),
        _rows(pairs, "reciprocal_citation", F.concat_ws(" / ", "a", "b"), F.col("severity"), F.col("score")), bursts(edges, years),
    ]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def health(anomalies: DataFrame) -> DataFrame:
    """One row: the five scores from 0 to 100 and their weighted sum; 100 where nothing was found."""
    kind, score = F.col("anomaly"), F.col("score")
    worst = lambda *k: F.coalesce(F.max(F.when(kind.isin(*k), score)), F.lit(0.0))
    any_ = lambda k: F.coalesce(F.max((kind == k).cast("int")), F.lit(0))
    parts = {
        "interconnection": 100 - 60 * worst("orphan_cluster"), "temporal": 100 - 20 * F.coalesce(F.sum(F.when(kind == "temporal_anomaly", score)), F.lit(0.0)),
        "self_citation": 100 - 40 * worst("excessive_self_citation", "self_citation_ring") - 20 * any_("self_citation_ring"), "benford": 100 - 50 * worst("benford_violation"),
        "reciprocal": 100 - 40 * worst("reciprocal_citation", "citation_burst") - 10 * any_("citation_burst"),
    }
    one = anomalies.agg(*(F.greatest(F.lit(0.0), x).alias(k) for k, x in parts.items()))
    total = sum(F.col(k) * w for k, w in HEALTH.items())
    return one.select(*(F.round(k, 4).alias(k) for k in HEALTH), F.round(total, 4).alias("overall"))


def graph_signals(anomalies: DataFrame) -> DataFrame:
    """(signal_name, fired, confidence): one row for each kind of anomaly, by its worst case."""
    table = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    worst = anomalies.groupBy("anomaly").agg(F.max(F.struct("score", "severity")).alias("w"))
    names = F.explode(F.array(*(F.struct(F.lit(a).alias("anomaly"), F.lit(s).alias("signal_name")) for a, s in SIGNAL.items()))).alias("x")
    every = anomalies.sparkSession.range(1).select(names).select("x.*")
    return every.join(worst, "anomaly", "left").select("signal_name", F.col("w").isNotNull().alias("fired"), F.coalesce(table[F.col("w.severity")], F.lit(0.0)).alias("confidence"))

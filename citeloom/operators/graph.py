"""Citation graphs as DataFrames: edges (src, dst), a multiset, and nodes (id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.session import cut

# Critical values of chi-squared with eight degrees of freedom, at 5 and 1 percent.
CHI2_8 = (15.507, 20.090)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming) with one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges in either direction connect each id to.

    Each round takes the smallest label among neighbours and then the label of that label;
    it is written to the checkpoint folder, so lineage stays short, and only one number
    comes back to the driver.
    """
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    both = cut(pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("component")))
    while True:
        labels = now.select("id", "component")
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = low.join(jump, "low", "left").select("id", "component", F.least("low", F.coalesce("far", "low")).alias("new"))
        now = cut(new.select("id", F.col("new").alias("component"), (F.col("new") != F.col("component")).alias("moved")), now)
        if not now.where("moved").limit(1).count():
            return now.select("id", "component")


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b, ab, ba), a < b: pairs with edges both ways and their numbers."""
    n = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    one = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    g = n.select(*one, F.when(F.col("src") < F.col("dst"), F.col("n")).alias("x"), F.when(F.col("src") > F.col("dst"), F.col("n")).alias("y"))
    return g.groupBy("a", "b").agg(F.sum("x").alias("ab"), F.sum("y").alias("ba")).where("ab IS NOT NULL AND ba IS NOT NULL")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a the smallest: directed rings of three, each once.

    Edges are made distinct first; every ring is met from its smallest member only.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    first = e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    second = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    third = e.where("src > dst").select(F.col("src").alias("c"), F.col("dst").alias("a"))
    return first.join(second, "b").where("c > a AND c <> b").join(third, ["a", "c"]).select("a", "b", "c")


def reciprocal(edges: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """Mutual pairs with at least `least` edges each way and a ratio above `share`, scored."""
    m = mutual(edges).where((F.col("ab") >= least) & (F.col("ba") >= least))
    ratio = F.least("ab", "ba") / F.greatest("ab", "ba")
    total = F.col("ab") + F.col("ba")
    return m.where(ratio > share).select("a", "b", "ab", "ba", F.round(ratio, 6).alias("ratio"), F.round(F.least(ratio * total / 20, F.lit(1.0)), 6).alias("score"))


def temporal(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, src_year, dst_year) to something later, with gap, severity and score."""
    gap = F.col("dst_year") - F.col("src_year")
    late = edges.where(gap > 0).withColumn("gap", gap)
    severity = F.when(F.col("gap") > 2, "critical").when(F.col("gap") > 1, "high").otherwise("medium")
    return late.withColumn("severity", severity).withColumn("score", F.round(F.least(F.col("gap") / 5, F.lit(1.0)), 6))


def benford(values: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, chi2, violated): first digits of positive numbers against their expected shares."""
    digit = F.substring(F.regexp_replace(F.format_number(F.col(value), 6), r"[^1-9]*", ""), 1, 1).cast("int")
    seen = values.where(F.col(value) > 0).select(group, digit.alias("digit")).where("digit IS NOT NULL").groupBy(group, "digit").agg(F.count("*").alias("o"))
    total = seen.groupBy(group).agg(F.sum("o").alias("n")).where("n >= 20")
    every = total.withColumn("digit", F.explode(F.sequence(F.lit(1), F.lit(9))))
    expected = F.col("n") * F.log10(1 + 1 / F.col("digit"))
    part = F.pow(F.coalesce("o", F.lit(0)) - expected, F.lit(2)) / expected
    chi2 = every.join(seen, [group, "digit"], "left").groupBy(group).agg(F.max("n").alias("n"), F.sum(part).alias("x"))
    return chi2.select(group, "n", F.round("x", 4).alias("chi2"), F.when(F.col("x") > CHI2_8[1], "high").when(F.col("x") > CHI2_8[0], "medium").otherwise("none").alias("violated"))


def bursts(counts: DataFrame, node: str, year: str, n: str, factor: float = 3.0) -> DataFrame:
    """(node, year, before, n): the first year of a node with more than `factor` times the year before it."""
    w = W.partitionBy(node).orderBy(year)
    steps = counts.select(node, year, n, F.lag(n).over(w).alias("before")).where((F.col("before") > 0) & (F.col(n) > factor * F.col("before")))
    return steps.groupBy(node).agg(F.min(F.struct(year, "before", n)).alias("s")).select(node, f"s.{year}", "s.before", f"s.{n}")


def concentration(edges: DataFrame, share: float, least: int = 3, top: int = 3) -> DataFrame:
    """(dst, sources, total, top_share): nodes whose `top` largest sources give more than `share`."""
    n = edges.groupBy("dst", "src").agg(F.count("*").alias("n"))
    w = W.partitionBy("dst").orderBy(F.desc("n"), "src")
    best = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("dst").agg(F.sum("n").alias("best"))
    every = n.groupBy("dst").agg(F.count("*").alias("sources"), F.sum("n").alias("total"))
    s = every.join(best, "dst").where(F.col("sources") >= least).withColumn("x", F.col("best") / F.col("total"))
    return s.where(F.col("x") > share).select("dst", "sources", "total", F.round("x", 6).alias("top_share"))


def densities(edges: DataFrame, least: int = 5) -> DataFrame:
    """(src, refs, inside, density): how far the things that src points to point to each other.

    Repeated edges count as often as they stand, as do repeated members.
    """
    member = edges.select("src", F.col("dst").alias("m"))
    refs = member.groupBy("src").agg(F.count("*").alias("refs")).where(F.col("refs") >= least)
    members = member.join(refs, "src").select("src", "m").distinct()
    inner = edges.groupBy("src", "dst").agg(F.count("*").alias("k")).select(F.col("src").alias("m"), F.col("dst").alias("t"), "k")
    inside = members.join(inner, "m").join(members.select("src", F.col("m").alias("t")), ["src", "t"]).groupBy("src").agg(F.sum("k").alias("inside"))
    s = refs.join(inside, "src", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return s.select("src", "refs", "inside", F.round(F.col("inside") / (F.col("refs") * (F.col("refs") - 1)), 6).alias("density"))


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, via, dst): different paths of two edges to something that src does not point to itself."""
    e = edges.select("src", "dst").distinct()
    a, b = e.select("src", F.col("dst").alias("via")), e.select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").where("src <> dst").join(e, ["src", "dst"], "left_anti").select("src", "via", "dst")


def health(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mutual share, mean degree, and a score from 0 to 100."""
    e = edges.agg(F.count("*").alias("edges"))
    n = degrees(edges).agg(F.count("*").alias("nodes"))
    m = mutual(edges).agg(F.coalesce(F.sum(F.col("ab") + F.col("ba")), F.lit(0)).alias("both"))
    s = e.crossJoin(n).crossJoin(m)  # three single rows
    density = F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))
    share: Column = F.col("both") / F.col("edges")
    return s.select("nodes", "edges", F.round(density, 6).alias("density"), F.round(share, 6).alias("mutual_share"), F.round(F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), F.round(100 - 40 * F.least(share, F.lit(1.0)), 4).alias("score"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 12) -> DataFrame:
    """(id, steps): what is reached from roots (id) over (src, dst), with the fewest steps up to depth.

    Only what the last round added is joined in the next; each round is written out.
    """
    e = edges.select("src", "dst").distinct()
    seen = cut(roots.select("id", F.lit(0).alias("steps")).distinct())
    edge = seen
    for k in range(1, depth + 1):
        new = edge.join(e, edge["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        edge = cut(new.select("id", F.lit(k).alias("steps")))
        if not edge.limit(1).count():
            break
        seen = cut(seen.unionByName(edge))
    return seen

"""Evaluation aggregates: calibration, confusion, thresholds, quantiles, retrieval."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reliability(scored: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): equal-width bins of a probability, 1.0 in the last one."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration(scored: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row (n, ece, mce, brier)."""
    r = reliability(scored, p, y, bins).withColumn("gap", F.abs(F.col("rate") - F.col("mean_p")))
    e = r.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))
    b = scored.where(F.col(p).isNotNull()).agg(F.round(F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2)), 6).alias("brier"))
    return e.crossJoin(b)  # one row by one row


def confusion(scored: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1), one against the rest, plus the sums as 'micro'."""
    cells = scored.groupBy(truth, guess).agg(F.count("*").alias("n"))
    t = cells.select(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(truth) == F.col(guess), 0).otherwise(F.col("n")).alias("fn"))
    g = cells.where(F.col(truth) != F.col(guess)).select(F.col(guess).alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"))
    s = t.unionByName(g).groupBy("label").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    s = s.unionByName(s.agg(F.lit("micro").alias("label"), *(F.sum(k).alias(k) for k in ("tp", "fp", "fn"))))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(share(2 * p * r, p + r), 6).alias("f1"))


def at_thresholds(scored: DataFrame, p: str, y: str, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, fpr): one pass, a few conditional counts per threshold."""
    y_ = F.col(y).cast("boolean")
    aggs = [F.count_if(y_).alias("pos"), F.count_if(~y_).alias("neg")]
    for k, t in enumerate(thresholds):
        aggs += [F.count_if((F.col(p) >= t) & y_).alias(f"tp{k}"), F.count_if((F.col(p) >= t) & ~y_).alias(f"fp{k}")]
    one = scored.where(F.col(p).isNotNull()).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), "pos", "neg") for k, t in enumerate(thresholds)))
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    safe = lambda a, b, none: F.round(F.coalesce(F.try_divide(a, b), F.lit(none)), 6)
    return r.select("threshold", safe(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), safe(F.col("tp"), F.col("pos"), 0.0).alias("recall"), safe(F.col("fp"), F.col("neg"), 0.0).alias("fpr"))


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, q, value): the element at place floor(n q) of each group's sorted values, exactly.

    A sketch first narrows each quantile to a small range; only values in it are ranked.
    """
    rows = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    eps, accuracy = 0.0005, 10_000
    wide = sorted({max(0.0, min(1.0, q + s * eps)) for q in shares for s in (-1, 1)})
    sketch = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx("v", [float(x) for x in wide], accuracy).alias("cuts"))
    want = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(wide.index(max(0.0, q - eps))).alias("i"), F.lit(wide.index(min(1.0, q + eps))).alias("j")) for q in shares))
    ranges = sketch.select(group, "n", F.transform(want, lambda w: F.struct(w.q.alias("q"), F.get("cuts", w.i).alias("lo"), F.get("cuts", w.j).alias("hi"))).alias("ranges"))
    met = rows.join(ranges, group)
    # one pass over the rows: a count below each range, and only rows inside one are multiplied
    lows = F.array(*(F.struct(F.lit(q).alias("q"), F.count_if(F.col("v") < F.get("ranges", F.lit(k)).lo).alias("below")) for k, q in enumerate(shares)))
    below = met.groupBy(group).agg(F.first("n").alias("n"), lows.alias("b")).select(group, "n", F.explode("b").alias("b")).select(group, "n", "b.q", "b.below")
    within = met.select(group, "v", F.explode(F.filter("ranges", lambda r: (F.col("v") >= r.lo) & (F.col("v") <= r.hi))).alias("r"))
    # equal values are counted before they are ordered, so a value that many rows have is one row
    inside = within.groupBy(group, F.col("r.q").alias("q"), "v").agg(F.count("*").alias("k"))
    upto = inside.withColumn("upto", F.sum("k").over(W.partitionBy(group, "q").orderBy("v"))).join(below, [group, "q"])
    place = F.least(F.floor(F.col("n") * F.col("q")), F.col("n") - 1) + 1
    return upto.where(F.col("upto") + F.col("below") >= place).groupBy(group, "q").agg(F.min("v").alias("value"))


def ranking_metrics(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """(k, queries, hit, precision, recall, mrr, ndcg) of (query, rank, relevant, n_relevant)."""
    top = ranked.select("query", "rank", F.col("relevant").cast("int").alias("r"), "n_relevant")
    out = None
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
        q = top.where(F.col("rank") <= k).groupBy("query").agg(
            F.sum("r").alias("hits"), F.max("n_relevant").alias("n_relevant"), F.min(F.when(F.col("r") == 1, F.col("rank"))).alias("first"), F.sum(F.col("r") / F.log2(F.col("rank") + 1)).alias("dcg")
        )
        one = q.agg(
            F.lit(k).alias("k"), F.count("*").alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit"), F.round(F.sum("hits") / (F.lit(k) * F.count("*")), 6).alias("precision"),
            F.round(F.sum("hits") / F.sum("n_relevant"), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0)), 6).alias("ndcg"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def phi(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Correlation of two yes/no columns from their counts."""
    return (n * ab - a * b) / F.sqrt(a * b * (n - a) * (n - b))


def cofire(fired: DataFrame, case: str, signal: str, total: int, least: int = 10) -> DataFrame:
    """(signal_a, signal_b, both, phi) of signals that fired at least `least` times; a few signals."""
    counts = fired.groupBy(signal).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    x = fired.join(F.broadcast(counts), signal)  # one row per signal
    a = x.select(case, F.col(signal).alias("signal_a"), F.col("n").alias("na"))
    b = x.select(case, F.col(signal).alias("signal_b"), F.col("n").alias("nb"))
    both = a.join(b, case).where("signal_a < signal_b").groupBy("signal_a", "signal_b").agg(F.count("*").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    n = F.lit(float(total))
    return both.select("signal_a", "signal_b", "both", F.round(phi(F.col("na"), F.col("nb"), F.col("both"), n), 6).alias("phi"))




def auc(scored: DataFrame, p: str, y: str, buckets: int = 1000) -> DataFrame:
    """One row (positives, negatives, auc): the share of pairs ranked right, ties counted half.

    Scores in [0, 1] are counted by value; the sum over lower scores is taken within a bucket
    of scores and between buckets, so no task orders all rows.
    """
    b = F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)).cast("int")
    n = scored.where(F.col(p).isNotNull()).groupBy(b.alias("b"), F.col(p).alias("p")).agg(F.count_if(F.col(y).cast("boolean")).alias("pos"), F.count_if(~F.col(y).cast("boolean")).alias("neg"))
    inside = W.partitionBy("b").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("low", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    per = n.groupBy("b").agg(F.sum("neg").alias("bn"))  # at most `buckets` rows
    below = per.withColumn("under", F.coalesce(F.sum("bn").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    right = n.join(F.broadcast(below.select("b", "under")), "b")
    s = right.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (F.col("low") + F.col("under") + F.col("neg") / 2)).alias("u"))
    return s.select("positives", "negatives", F.round(F.col("u") / (F.col("positives") * F.col("negatives")), 6).alias("auc"))


def platt(scored: DataFrame, key: str, p: str, y: str, folds: int = 5) -> DataFrame:
    """(key, fold, calibrated): out-of-fold logistic calibration of a probability.

    Folds come from a hash of the key; each fold's model is fitted on the other folds.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    base = scored.where(F.col(p).isNotNull()).select(F.col(key), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"), F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("label"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(base)
    out = None
    for k in range(folds):
        model = LogisticRegression(maxIter=50).fit(data.where(F.col("fold") != k))
        part = model.transform(data.where(F.col("fold") == k)).select(key, "fold", F.round(vector_to_array("probability")[1], 6).alias("calibrated"))
        out = part if out is None else out.unionByName(part)
    return out

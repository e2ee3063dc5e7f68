"""From signals to risk: naive Bayes, grouped Bayes and Dempster–Shafer, as aggregates.

Signals come in one long table (ref_id, seq, signal_name, fired, confidence). Parameter
tables can be replaced by the caller; the defaults below are the published values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Likelihood ratios of a signal that fired and of one that did not.
SIGNALS = {
    "reference_not_found": (15.0, 0.95),
    "phantom_doi": (25.0, 0.99),
    "metadata_mismatch": (10.0, 0.85),
    "no_id_match": (6.0, 0.92),
    "chimera_detected": (8.0, 0.95),
    "retracted_citation": (8.0, 0.99),
    "citation_misrepresents_source": (5.0, 0.85),
    "all_citations_mentioning": (2.0, 0.95),
    "claim_contradicted": (6.0, 0.90),
    "claim_unsupported": (3.0, 0.85),
    "citation_ring_detected": (10.0, 0.95),
    "excessive_self_citation": (4.0, 0.90),
    "temporal_anomaly": (8.0, 0.98),
    "orphan_cluster": (2.5, 0.92),
    "benford_violation": (6.0, 0.95),
    "reciprocal_citation": (5.0, 0.92),
    "citation_burst": (3.0, 0.95),
    "tortured_phrases": (25.0, 0.99),
    "suspicious_email": (4.0, 0.95),
    "grim_test_failure": (50.0, 0.99),
    "statcheck_error": (8.0, 0.95),
}
# Signals that count once per group, and those that stand alone.
GROUPS = {
    "existence": ("reference_not_found", "phantom_doi"),
    "metadata": ("metadata_mismatch", "no_id_match"),
    "semantic": ("claim_contradicted", "claim_unsupported"),
    "graph": ("citation_ring_detected", "excessive_self_citation", "temporal_anomaly", "orphan_cluster"),
    "text": ("tortured_phrases", "suspicious_email"),
    "stats": ("grim_test_failure", "statcheck_error"),
}
ALONE = ("all_citations_mentioning", "citation_misrepresents_source", "retracted_citation")
# Prior share of problematic references by field.
PRIORS = {"cancer_research": 0.10, "biomedical": 0.05, "computer_science": 0.02, "social_science": 0.03, "psychology": 0.04, "engineering": 0.02, "humanities": 0.01, "default": 0.03}
PRIOR_STRENGTH = 0.8
MASS = "struct<p:double,l:double,t:double>"


def definitions(spark: SparkSession, signals: dict[str, tuple[float, float]] = SIGNALS) -> DataFrame:
    """(signal_name, lr_pos, lr_neg, group_name): one row per known signal, a fixed few."""
    group = {s: g for g, names in GROUPS.items() for s in names} | {s: s for s in ALONE}
    return spark.createDataFrame([(s, *v, group.get(s)) for s, v in signals.items()], "signal_name string, lr_pos double, lr_neg double, group_name string")


def tier(p: Column) -> Column:
    return F.when(p >= 0.5, "critical").when(p >= 0.2, "high").when(p >= 0.05, "elevated").otherwise("low")


def first_seen(signals: DataFrame) -> DataFrame:
    """The first observation of each signal of a reference, with its confidence in [0, 1]."""
    one = signals.groupBy("ref_id", "signal_name").agg(F.min_by(F.struct("fired", "confidence"), "seq").alias("o"))
    return one.select("ref_id", "signal_name", "o.fired", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "o.confidence")).alias("confidence"))


def _known(signals: DataFrame, defs: DataFrame) -> DataFrame:
    d = first_seen(signals).join(F.broadcast(defs), "signal_name")  # a fixed few rows
    return d.withColumn("llr", F.col("confidence") * F.when(F.col("fired"), F.log("lr_pos")).otherwise(F.log("lr_neg")))


def _posterior(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log_odds))))


def naive_bayes(signals: DataFrame, defs: DataFrame, prior: float = PRIORS["default"]) -> DataFrame:
    """(ref_id, posterior, tier, fired): log odds of the prior plus those of all signals."""
    s = _known(signals, defs).groupBy("ref_id").agg(F.sum("llr").alias("llr"), F.count_if("fired").alias("fired"))
    p = _posterior(F.col("llr") + math.log(prior / (1 - prior)))
    return s.select("ref_id", F.round(p, 6).alias("posterior"), tier(p).alias("tier"), "fired")


def grouped_bayes(signals: DataFrame, defs: DataFrame, prior: float = PRIORS["default"]) -> DataFrame:
    """As naive_bayes, but of each group of correlated signals only the strongest counts.

    Signals in no group do not count. Adds the conflict between evidence for and against.
    """
    g = _known(signals, defs).where("group_name IS NOT NULL").groupBy("ref_id", "group_name").agg(F.max_by("llr", F.struct(F.abs("llr"), "signal_name")).alias("llr"))
    pos = F.sum(F.when(F.col("llr") > 0.1, F.col("llr")).otherwise(0.0))
    neg = F.sum(F.when(F.col("llr") < -0.1, -F.col("llr")).otherwise(0.0))
    s = g.groupBy("ref_id").agg(F.sum("llr").alias("llr"), pos.alias("pos"), neg.alias("neg"))
    p = _posterior(F.col("llr") + math.log(prior / (1 - prior)))
    return s.select("ref_id", F.round(p, 6).alias("posterior"), tier(p).alias("tier"), F.round(F.least("pos", "neg") / F.greatest(F.col("pos") + F.col("neg"), F.lit(1.0)), 6).alias("conflict"))


def masses(signals: DataFrame, defs: DataFrame) -> DataFrame:
    """(ref_id, group_name, p, l, t): one mass per group, the one that believes most in a problem."""
    p = F.when(F.col("fired"), (1 - 1 / F.col("lr_pos")) * F.col("confidence")).otherwise(0.0)
    l = F.when(F.col("fired"), 0.0).otherwise((1 - F.col("lr_neg")) * F.col("confidence"))
    m = _known(signals, defs).where("group_name IS NOT NULL").select("ref_id", "group_name", "signal_name", p.alias("p"), l.alias("l"))
    belief = F.when(F.col("p") > 0, F.col("p")).otherwise(-F.col("l"))
    best = m.groupBy("ref_id", "group_name").agg(F.max_by(F.struct("p", "l"), F.struct(belief, "signal_name")).alias("m"))
    return best.select("ref_id", "group_name", "m.p", "m.l", (1 - F.col("m.p") - F.col("m.l")).alias("t"))


def combine(a: Column, b: Column) -> Column:
    """Dempster's rule for masses over {problem, legitimate, either}; total conflict says nothing."""
    k = 1 - a.p * b.l - a.l * b.p
    part = lambda x: F.when(k > 1e-12, x / k)
    return F.struct(
        F.coalesce(part(a.p * b.p + a.p * b.t + a.t * b.p), F.lit(0.0)).alias("p"), F.coalesce(part(a.l * b.l + a.l * b.t + a.t * b.l), F.lit(0.0)).alias("l"), F.coalesce(part(a.t * b.t), F.lit(1.0)).alias("t")
    )


def dempster_shafer(signals: DataFrame, defs: DataFrame, prior: float = PRIORS["default"]) -> DataFrame:
    """(ref_id, belief, plausibility, posterior, tier): groups combined in the order of their names.

    There are no more masses per reference than groups, so the fold is over a short array.
    """
    m = masses(signals, defs)
    listed = m.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("group_name", F.struct("p", "l", "t").alias("m")))).alias("ms"))
    start = F.struct(F.lit(prior * PRIOR_STRENGTH).alias("p"), F.lit((1 - prior) * PRIOR_STRENGTH).alias("l"), F.lit(1 - PRIOR_STRENGTH).alias("t"))
    c = listed.select("ref_id", F.aggregate("ms", start.cast(MASS), lambda acc, x: combine(acc, x.m).cast(MASS)).alias("c"))
    p = F.col("c.p") + F.col("c.t") / 2
    return c.select("ref_id", F.round("c.p", 6).alias("belief"), F.round(F.col("c.p") + F.col("c.t"), 6).alias("plausibility"), F.round(p, 6).alias("posterior"), tier(p).alias("tier"))


def murphy(signals: DataFrame, defs: DataFrame, prior: float = PRIORS["default"]) -> DataFrame:
    """(ref_id, posterior): the average of all masses, combined with itself as often as there are others."""
    m = masses(signals, defs)
    s = m.groupBy("ref_id").agg(*(F.sum(k).alias(k) for k in "plt"), F.count("*").alias("n"))
    own = {"p": prior * PRIOR_STRENGTH, "l": (1 - prior) * PRIOR_STRENGTH, "t": 1 - PRIOR_STRENGTH}
    mean = F.struct(*(((F.col(k) + own[k]) / (F.col("n") + 1)).alias(k) for k in "plt")).cast(MASS)
    c = s.select("ref_id", mean.alias("m"), "n").select("ref_id", F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.col("m"), lambda acc, _: combine(acc, F.col("m")).cast(MASS)).alias("c"))
    return c.select("ref_id", F.round(F.col("c.p") + F.col("c.t") / 2, 6).alias("posterior"))


def empirical_ratios(observed: DataFrame, laplace: float = 1.0) -> DataFrame:
    """(signal_name, n_bad, n_good, lr_pos, lr_neg) from (signal_name, fired, bad): smoothed rates."""
    bad, fired = F.col("bad"), F.col("fired")
    s = observed.groupBy("signal_name").agg(
        F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_good"), F.count_if(bad & fired).alias("fb"), F.count_if(~bad & fired).alias("fg")
    )
    a, b = (F.col("fb") + laplace) / (F.col("n_bad") + 2 * laplace), (F.col("fg") + laplace) / (F.col("n_good") + 2 * laplace)
    return s.select("signal_name", "n_bad", "n_good", F.round(a / b, 6).alias("lr_pos"), F.round((1 - a) / (1 - b), 6).alias("lr_neg"))


def matrix(signals: DataFrame, names: list[str]) -> DataFrame:
    """One row per reference and a 0/1 column per signal."""
    s = first_seen(signals)
    return s.groupBy("ref_id").agg(*(F.max(F.when((F.col("signal_name") == n) & F.col("fired"), 1).otherwise(0)).alias(n) for n in names))


def logistic_ratios(rows: DataFrame, names: list[str], label: str, strength: float = 1.0) -> DataFrame:
    """(signal_name, lr): exp of the weights of a ridge logistic regression on a signal matrix."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("label", F.col(label).cast("double")))
    n = data.count()
    model = LogisticRegression(maxIter=100, regParam=1 / (strength * max(1, n)), standardization=False).fit(data)
    return rows.sparkSession.createDataFrame([(s, round(math.exp(w), 6)) for s, w in zip(names, model.coefficients)], "signal_name string, lr double")

"""Queries of fusion, evaluation, claims and retrieval, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.similarity import p_value
from citeloom.operators import claims as C
from citeloom.operators import evaluate as E
from citeloom.operators import fusion as S
from citeloom.operators import references as R
from citeloom.operators import retrieval
from citeloom.plans import text_queries as T
from citeloom.plans.registry import SQL, query
from citeloom.session import table

LAST_YEAR = 2024
DEFS_SQL = "defs(signal_name, lr_pos, lr_neg, grp) AS (VALUES " + ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, " + (f"'{g}'" if (g := next((g for g, n in S.GROUPS.items() if s in n), s if s in S.ALONE else None)) else "NULL") + ")" for s, (a, b) in S.SIGNALS.items()) + ")"

SIGNALS_SQL = (
    T.CHECKS
    + f""", score AS (SELECT ref_id, round(avg({T.WORTH.format("status")}), 6) AS ms FROM checks GROUP BY ref_id),
    look AS ({SQL["id_lookup_then_search"]}),
    nli AS (SELECT ref_id, bool_or(label = 'CONTRADICTED') AS con, max(contradiction_score) AS cs, bool_or(label = 'NOT_ENOUGH_INFO') AS nei FROM nli_results GROUP BY ref_id),
    base AS (SELECT r.ref_id, look.found_id IS NULL AS missing, coalesce(score.ms < 65, false) AS mismatch, {T._doi("r.doi")} IS NULL AS no_id, coalesce({T.YEAR.format("r.year")} > {LAST_YEAR}, false) AS late, coalesce(nli.con, false) AS con, coalesce(nli.cs, 0.5) AS cs, coalesce(nli.nei, false) AS nei
        FROM bib_references r LEFT JOIN look USING (ref_id) LEFT JOIN score USING (ref_id) LEFT JOIN nli USING (ref_id)),
    signals AS (SELECT ref_id, 1 AS seq, 'reference_not_found' AS signal_name, missing AS fired, 0.9::DOUBLE AS confidence FROM base UNION ALL SELECT ref_id, 2, 'metadata_mismatch', mismatch, 0.8 FROM base
        UNION ALL SELECT ref_id, 3, 'no_id_match', no_id, 0.6 FROM base UNION ALL SELECT ref_id, 4, 'temporal_anomaly', late, 0.95 FROM base
        UNION ALL SELECT ref_id, 5, 'claim_contradicted', con, cs FROM base UNION ALL SELECT ref_id, 6, 'claim_unsupported', nei, 0.5 FROM base), """
    + DEFS_SQL
    + ", known AS (SELECT ref_id, signal_name, fired, confidence, lr_pos, lr_neg, grp, confidence * CASE WHEN fired THEN ln(lr_pos) ELSE ln(lr_neg) END AS llr FROM signals JOIN defs USING (signal_name))"
)
PRIOR = S.PRIORS["default"]
ODDS = math.log(PRIOR / (1 - PRIOR))
TIER = "CASE WHEN {0} >= 0.5 THEN 'critical' WHEN {0} >= 0.2 THEN 'high' WHEN {0} >= 0.05 THEN 'elevated' ELSE 'low' END"


def signals_of(spark: SparkSession, d: str) -> DataFrame:
    """The long table of signals of all references: six signals each, from three tables."""
    refs = table(spark, d, "bib_references")
    score = R.match_scores(T.checks_of(spark, d)).select("ref_id", F.col("match_score").alias("ms"))
    look = T.id_lookup_then_search(spark, d).select("ref_id", "found_id")
    n = table(spark, d, "nli_results").groupBy("ref_id").agg(F.bool_or(F.col("label") == "CONTRADICTED").alias("con"), F.max("contradiction_score").alias("cs"), F.bool_or(F.col("label") == "NOT_ENOUGH_INFO").alias("nei"))
    base = refs.select("ref_id", "doi", "year").join(look, "ref_id", "left").join(score, "ref_id", "left").join(n, "ref_id", "left")
    no = F.lit(False)
    fired = (
        ("reference_not_found", F.col("found_id").isNull(), F.lit(0.9)), ("metadata_mismatch", F.coalesce(F.col("ms") < 65, no), F.lit(0.8)), ("no_id_match", X.clean_doi("doi").isNull(), F.lit(0.6)),
        ("temporal_anomaly", F.coalesce(X.first_year("year") > LAST_YEAR, no), F.lit(0.95)), ("claim_contradicted", F.coalesce("con", no), F.coalesce("cs", F.lit(0.5))), ("claim_unsupported", F.coalesce("nei", no), F.lit(0.5)),
    )
    rows = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(s).alias("signal_name"), f.alias("fired"), c.alias("confidence")) for k, (s, f, c) in enumerate(fired, 1)))
    return base.select("ref_id", F.explode(rows).alias("s")).select("ref_id", "s.*")


@query(SIGNALS_SQL + " SELECT ref_id, seq, signal_name, fired, round(confidence, 6) AS confidence FROM signals")
def signals(spark: SparkSession, d: str) -> DataFrame:
    return signals_of(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(SIGNALS_SQL + f" SELECT ref_id, round(p, 6) AS posterior, {TIER.format('p')} AS tier, fired FROM (SELECT ref_id, 1 / (1 + exp(-({ODDS} + sum(llr)))) AS p, count_if(fired)::BIGINT AS fired FROM known GROUP BY ref_id)")
def risk_naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    return S.naive_bayes(signals_of(spark, d), S.definitions(spark))


@query(
    SIGNALS_SQL
    + f""", g AS (SELECT ref_id, grp, arg_max(llr, struct_pack(a := abs(llr), s := signal_name)) AS llr FROM known WHERE grp IS NOT NULL GROUP BY ref_id, grp),
    t AS (SELECT ref_id, 1 / (1 + exp(-({ODDS} + sum(llr)))) AS p, sum(CASE WHEN llr > 0.1 THEN llr ELSE 0 END) AS pos, sum(CASE WHEN llr < -0.1 THEN -llr ELSE 0 END) AS neg FROM g GROUP BY ref_id)
    SELECT ref_id, round(p, 6) AS posterior, {TIER.format("p")} AS tier, round(least(pos, neg) / greatest(pos + neg, 1), 6) AS conflict FROM t"""
)
def risk_grouped_bayes(spark: SparkSession, d: str) -> DataFrame:
    return S.grouped_bayes(signals_of(spark, d), S.definitions(spark))


MASSES = (
    SIGNALS_SQL
    + """, e AS (SELECT ref_id, grp, signal_name, CASE WHEN fired THEN (1 - 1 / lr_pos) * confidence ELSE 0 END AS p, CASE WHEN fired THEN 0 ELSE (1 - lr_neg) * confidence END AS l FROM known WHERE grp IS NOT NULL),
    mass AS (SELECT ref_id, grp, arg_max(struct_pack(p := p, l := l, t := 1 - p - l), struct_pack(b := CASE WHEN p > 0 THEN p ELSE -l END, s := signal_name)) AS m FROM e GROUP BY ref_id, grp)"""
)
FOLD = """lambda a, b: struct_pack(p := (a.p * b.p + a.p * b.t + a.t * b.p) / (1 - a.p * b.l - a.l * b.p), l := (a.l * b.l + a.l * b.t + a.t * b.l) / (1 - a.p * b.l - a.l * b.p), t := (a.t * b.t) / (1 - a.p * b.l - a.l * b.p))"""


@query(
    MASSES
    + f""", c AS (SELECT ref_id, list_reduce(list_concat([struct_pack(p := {PRIOR * 0.8}::DOUBLE, l := {(1 - PRIOR) * 0.8}::DOUBLE, t := 0.2::DOUBLE)], list(struct_pack(p := m.p::DOUBLE, l := m.l::DOUBLE, t := m.t::DOUBLE) ORDER BY grp)), {FOLD}) AS c FROM mass GROUP BY ref_id)
    SELECT ref_id, round(c.p, 6) AS belief, round(c.p + c.t, 6) AS plausibility, round(c.p + c.t / 2, 6) AS posterior, {TIER.format("(c.p + c.t / 2)")} AS tier FROM c"""
)
def risk_dempster_shafer(spark: SparkSession, d: str) -> DataFrame:
    return S.dempster_shafer(signals_of(spark, d), S.definitions(spark))


@query(
    MASSES
    + f""", a AS (SELECT ref_id, count(*) AS n, struct_pack(p := (sum(m.p) + {PRIOR * 0.8}) / (count(*) + 1), l := (sum(m.l) + {(1 - PRIOR) * 0.8}) / (count(*) + 1), t := (sum(m.t) + 0.2) / (count(*) + 1)) AS m FROM mass GROUP BY ref_id),
    c AS (SELECT ref_id, list_reduce(list_transform(range(n + 1), lambda i: m), {FOLD}) AS c FROM a) SELECT ref_id, round(c.p + c.t / 2, 6) AS posterior FROM c"""
)
def risk_murphy(spark: SparkSession, d: str) -> DataFrame:
    return S.murphy(signals_of(spark, d), S.definitions(spark))


@query(
    SIGNALS_SQL
    + """, o AS (SELECT s.signal_name, s.fired, b.con AS bad FROM signals s JOIN base b USING (ref_id) WHERE s.signal_name NOT LIKE 'claim%'),
    c AS (SELECT signal_name, count_if(bad)::BIGINT AS n_bad, count_if(NOT bad)::BIGINT AS n_good, (count_if(bad AND fired) + 1.0) / (count_if(bad) + 2.0) AS a, (count_if(NOT bad AND fired) + 1.0) / (count_if(NOT bad) + 2.0) AS b FROM o GROUP BY signal_name)
    SELECT signal_name, n_bad, n_good, round(a / b, 6) AS lr_pos, round((1 - a) / (1 - b), 6) AS lr_neg FROM c"""
)
def empirical_lr(spark: SparkSession, d: str) -> DataFrame:
    s = signals_of(spark, d)
    bad = s.where("signal_name = 'claim_contradicted'").select("ref_id", F.col("fired").alias("bad"))
    return S.empirical_ratios(s.where("signal_name NOT LIKE 'claim%'").join(bad, "ref_id"))


@query(SIGNALS_SQL + " SELECT signal_name, count(*) AS n, round(avg(CASE WHEN fired THEN 1.0 ELSE 0.0 END), 6) AS fire_rate FROM signals GROUP BY signal_name")
def signal_fire_rates(spark: SparkSession, d: str) -> DataFrame:
    return signals_of(spark, d).groupBy("signal_name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("fired").cast("double")), 6).alias("fire_rate"))


@query(
    SIGNALS_SQL
    + """, f AS (SELECT ref_id, signal_name FROM signals WHERE fired), n AS (SELECT signal_name, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT count(*)::DOUBLE AS t FROM bib_references),
    ab AS (SELECT a.signal_name AS signal_a, b.signal_name AS signal_b, count(*) AS k FROM f a JOIN f b ON a.ref_id = b.ref_id AND a.signal_name < b.signal_name GROUP BY 1, 2)
    SELECT signal_a, signal_b, k AS "both", round((t * k - x.n * y.n) / sqrt(x.n * y.n * (t - x.n) * (t - y.n)), 6) AS phi FROM ab JOIN n x ON x.signal_name = signal_a JOIN n y ON y.signal_name = signal_b, t"""
)
def signal_phi_cofire(spark: SparkSession, d: str) -> DataFrame:
    s = signals_of(spark, d).where("fired").select("ref_id", "signal_name")
    return E.cofire(s, "ref_id", "signal_name", table(spark, d, "bib_references").count())


# per bibliography file
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
# Weights of metadata accuracy, existence, graph, semantics and integrity by kind of document.
PROFILES = {"academic": (0.15, 0.20, 0.20, 0.30, 0.15), "patent": (0.20, 0.30, 0.10, 0.25, 0.15), "legal": (0.25, 0.30, 0.05, 0.25, 0.15), "financial": (0.20, 0.25, 0.05, 0.30, 0.20), "standard": (0.20, 0.25, 0.15, 0.25, 0.15)}
BIB_SQL = (
    T.CHECKS
    + f""", look AS ({SQL["id_lookup_then_search"]}), meta AS (SELECT bib_file, avg({T.WORTH.format("status")}) AS m FROM checks JOIN bib_references USING (ref_id) GROUP BY bib_file),
    ex AS (SELECT bib_file, count(*) AS refs, count(found_id) AS found FROM bib_references LEFT JOIN look USING (ref_id) GROUP BY bib_file)"""
)


def bib_scores(spark: SparkSession, d: str) -> DataFrame:
    """(bib_file, refs, found, metadata, existence) of every bibliography file."""
    refs = table(spark, d, "bib_references").select("ref_id", "bib_file")
    meta = T.checks_of(spark, d).join(refs, "ref_id").groupBy("bib_file").agg(F.avg(R.worth("status")).alias("metadata"))
    ex = refs.join(T.id_lookup_then_search(spark, d).select("ref_id", "found_id"), "ref_id", "left").groupBy("bib_file").agg(F.count("*").alias("refs"), F.count("found_id").alias("found"))
    return ex.join(meta, "bib_file", "left").select("bib_file", "refs", "found", F.coalesce("metadata", F.lit(100.0)).alias("metadata"), (100.0 * F.col("found") / F.col("refs")).alias("existence"))


@query(BIB_SQL + " SELECT bib_file, refs, found, round(coalesce(m, 100), 6) AS metadata, round(100.0 * found / refs, 6) AS existence FROM ex LEFT JOIN meta USING (bib_file)")
def bibliography_scores(spark: SparkSession, d: str) -> DataFrame:
    return bib_scores(spark, d).withColumn("metadata", F.round("metadata", 6)).withColumn("existence", F.round("existence", 6))


@query(
    BIB_SQL
    + ", p(profile, a, b, c) AS (VALUES "
    + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2] + v[3] + v[4]}::DOUBLE)" for k, v in PROFILES.items())
    + f"), sc AS (SELECT bib_file, profile, round((a * coalesce(m, 100) + b * 100.0 * found / refs + c * 100) / (a + b + c), 4) AS score FROM ex LEFT JOIN meta USING (bib_file), p) SELECT bib_file, profile, score, {GRADE.format('score')} AS grade FROM sc"
)
def integrity_score_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("profile"), F.lit(v[0]).alias("a"), F.lit(v[1]).alias("b"), F.lit(v[2] + v[3] + v[4]).alias("c")) for k, v in PROFILES.items()))
    s = bib_scores(spark, d).select("bib_file", "metadata", "existence", F.explode(rows).alias("p")).select("*", "p.*")
    score = F.round((F.col("a") * F.col("metadata") + F.col("b") * F.col("existence") + F.col("c") * 100) / (F.col("a") + F.col("b") + F.col("c")), 4)
    s = s.select("bib_file", "profile", score.alias("score"))
    x = F.col("score")
    return s.withColumn("grade", F.when(x >= 90, "A").when(x >= 80, "B").when(x >= 70, "C").when(x >= 60, "D").otherwise("F"))


@query(T.CHECKS + " SELECT ref_id, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'OK' END AS overall FROM checks GROUP BY ref_id")
def overall_status(spark: SparkSession, d: str) -> DataFrame:
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return T.checks_of(spark, d).groupBy("ref_id").agg(worst.alias("w")).select("ref_id", F.element_at(F.array(*map(F.lit, ("OK", "WARN", "FAIL"))), F.col("w") + 1).alias("overall"))


@query(
    "SELECT bib_file, refs, round(share, 6) AS share FROM (SELECT bib_file, count(*) AS refs, avg(CASE WHEN length(title) - length(replace(title, ':', '')) = 1 THEN 1.0 ELSE 0.0 END) AS share FROM bib_references WHERE title <> '' GROUP BY bib_file) WHERE refs >= 5 AND share > 0.4"
)
def format_anomaly(spark: SparkSession, d: str) -> DataFrame:
    one = (F.length("title") - F.length(F.replace("title", F.lit(":"), F.lit(""))) == 1).cast("double")
    s = table(spark, d, "bib_references").where("title <> ''").groupBy("bib_file").agg(F.count("*").alias("refs"), F.avg(one).alias("share"))
    return s.where("refs >= 5 AND share > 0.4").select("bib_file", "refs", F.round("share", 6).alias("share"))


@query(
    """WITH c AS (SELECT paper_doi, lower(trim(journal)) AS j, count(*) AS n, min(match_id) AS f FROM sneaked_matches WHERE journal IS NOT NULL AND trim(journal) <> '' GROUP BY 1, 2), t AS (SELECT paper_doi, sum(n) AS t FROM c GROUP BY 1)
    SELECT paper_doi, arg_max(j, struct_pack(n := n, f := -f)) AS top_journal, round(max(n) / min(t), 6) AS top_share, round(sum(pow(n / t, 2)), 6) AS hhi FROM c JOIN t USING (paper_doi) GROUP BY paper_doi"""
)
def journal_hhi(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sneaked_matches").where(F.trim("journal") != "")
    c = m.groupBy("paper_doi", F.lower(F.trim("journal")).alias("j")).agg(F.count("*").alias("n"), F.min("match_id").alias("f"))
    g = c.groupBy("paper_doi").agg(F.max_by("j", F.struct("n", -F.col("f"))).alias("top_journal"), F.max("n").alias("m"), F.sum("n").alias("t"), F.sum(F.pow("n", F.lit(2))).alias("q"))
    return g.select("paper_doi", "top_journal", F.round(F.col("m") / F.col("t"), 6).alias("top_share"), F.round(F.col("q") / F.pow("t", F.lit(2)), 6).alias("hhi"))


@query(
    """WITH s AS (SELECT paper_doi, avg(CASE WHEN is_sneaked THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM sneaked_matches GROUP BY 1)
    SELECT paper_doi, n, round(r, 6) AS sneaked_share, CAST(least(100, CASE WHEN r > 0.5 THEN 70 WHEN r > 0.2 THEN 40 ELSE 0 END) AS INTEGER) AS score, r > 0.2 AS suspicious FROM s"""
)
def sneaked_risk(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sneaked_matches").groupBy("paper_doi").agg(F.avg(F.coalesce("is_sneaked", F.lit(False)).cast("double")).alias("r"), F.count("*").alias("n"))
    return s.select("paper_doi", "n", F.round("r", 6).alias("sneaked_share"), F.when(F.col("r") > 0.5, 70).when(F.col("r") > 0.2, 40).otherwise(0).alias("score"), (F.col("r") > 0.2).alias("suspicious"))


LABEL = "CASE WHEN {2} > {0} AND {2} > {1} THEN CASE WHEN {2} > 0.35 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END WHEN {0} > {2} AND {0} > {1} AND {0} > 0.5 THEN 'SUPPORTED' WHEN {0} > 0.25 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END"
NLI = LABEL.format("entailment_score", "neutral_score", "contradiction_score")


@query(f"SELECT result_id, {NLI} AS label FROM nli_results")
def nli_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nli_results").select("result_id", C.entailment_label(*(F.col(f"{k}_score") for k in ("entailment", "neutral", "contradiction"))).alias("label"))


@query(
    f"""SELECT ref_id, count(*) AS claims, round(avg(CASE {NLI} WHEN 'SUPPORTED' THEN 100.0 WHEN 'PARTIALLY_SUPPORTED' THEN 60.0 WHEN 'UNSUPPORTED' THEN 20.0 ELSE 0.0 END), 6) AS alignment FROM nli_results GROUP BY ref_id"""
)
def alignment_score(spark: SparkSession, d: str) -> DataFrame:
    label = C.entailment_label(*(F.col(f"{k}_score") for k in ("entailment", "neutral", "contradiction")))
    worth = F.when(label == "SUPPORTED", 100.0).when(label == "PARTIALLY_SUPPORTED", 60.0).when(label == "UNSUPPORTED", 20.0).otherwise(0.0)
    return table(spark, d, "nli_results").groupBy("ref_id").agg(F.count("*").alias("claims"), F.round(F.avg(worth), 6).alias("alignment"))


WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '\\s+')), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in C.STOP) + "], w))"


@query(
    f"""WITH w AS (SELECT result_id, {WORDS.format("claim")} AS c, {WORDS.format("premise")} AS p FROM nli_results WHERE claim IS NOT NULL AND premise IS NOT NULL),
    s AS (SELECT result_id, CASE WHEN len(c) > 0 THEN len(list_intersect(c, p))::DOUBLE / len(c) END AS coverage FROM w), e AS (SELECT *, least(coverage * 0.9, 0.95) AS ent FROM s)
    SELECT result_id, round(coverage, 6) AS coverage, CASE WHEN coverage IS NULL THEN 'UNVERIFIABLE' ELSE {LABEL.format("ent", "(0.95 - ent)", "0.05")} END AS label FROM e"""
)
def claim_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nli_results").where("claim IS NOT NULL AND premise IS NOT NULL").select("result_id", "claim", "premise")
    return C.overlap(n, "claim", "premise").select("result_id", F.round("coverage", 6).alias("coverage"), "label")


@query(
    "WITH s AS (SELECT count(*) AS n, avg(entailment_score) AS m, avg(CASE WHEN label = 'SUPPORTED' THEN 1.0 ELSE 0.0 END) AS r FROM nli_results WHERE entailment_score IS NOT NULL GROUP BY least(floor(entailment_score * 10), 9)), "
    "b AS (SELECT avg(pow(entailment_score - CASE WHEN label = 'SUPPORTED' THEN 1.0 ELSE 0.0 END, 2)) AS b FROM nli_results WHERE entailment_score IS NOT NULL) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(r - m)) / sum(n), 6) AS ece, round(max(abs(r - m)), 6) AS mce, round(min(b), 6) AS brier FROM s, b"
)
def calibration_ece(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nli_results").withColumn("y", F.coalesce(F.col("label") == "SUPPORTED", F.lit(False)))
    return E.calibration(n, "entailment_score", "y")


@query(
    f"""WITH r AS (SELECT label AS t, replace({NLI}, 'UNSUPPORTED', 'NOT_ENOUGH_INFO') AS g FROM nli_results), l AS (SELECT DISTINCT t AS label FROM r UNION SELECT DISTINCT g FROM r),
    c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label AND g = label) AS tp, (SELECT count(*) FROM r WHERE t <> label AND g = label) AS fp, (SELECT count(*) FROM r WHERE t = label AND g <> label) AS fn FROM l),
    a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c), s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM a)
    SELECT label, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    label = C.entailment_label(*(F.col(f"{k}_score") for k in ("entailment", "neutral", "contradiction")))
    n = table(spark, d, "nli_results").select(F.col("label").alias("truth"), F.when(label == "UNSUPPORTED", "NOT_ENOUGH_INFO").otherwise(label).alias("guess"))
    return E.confusion(n, "truth", "guess")


THRESHOLDS = [0.2, 0.35, 0.5, 0.65, 0.8]


@query(
    "WITH t(threshold) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in THRESHOLDS) + "), r AS (SELECT contradiction_score AS p, coalesce(label = 'CONTRADICTED', false) AS y FROM nli_results WHERE contradiction_score IS NOT NULL) "
    "SELECT threshold, round(CASE WHEN count_if(p >= threshold) > 0 THEN count_if(p >= threshold AND y)::DOUBLE / count_if(p >= threshold) ELSE 1 END, 6) AS \"precision\", round(count_if(p >= threshold AND y)::DOUBLE / count_if(y), 6) AS recall, round(count_if(p >= threshold AND NOT y)::DOUBLE / count_if(NOT y), 6) AS fpr FROM r, t GROUP BY threshold"
)
def precision_at_thresholds(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nli_results").withColumn("y", F.coalesce(F.col("label") == "CONTRADICTED", F.lit(False)))
    return E.at_thresholds(n, "contradiction_score", "y", THRESHOLDS)


@query(
    "WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type), q(q) AS (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) SELECT event_type, q, v[CAST(least(floor(len(v) * q), len(v) - 1) AS BIGINT) + 1] AS value FROM s, q"
)
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_ranks(table(spark, d, "events"), "event_type", "value", [0.5, 0.95, 0.99])


def _intent_sql() -> str:
    named = f"regexp_replace(text, '\\([A-Z][a-z]+(?:\\s+et\\s+al\\.?)?,?\\s*\\d{{4}}\\)', ' [CIT] ', 'g')"
    marked = f"regexp_replace({named}, '\\[[\\d,;\\s]+\\]', ' [CIT] ', 'g')"
    tex = f"regexp_replace({marked}, '~?\\\\cite[a-zA-Z]*\\*?(?:\\[[^\\]]*\\])*\\{{[^}}]*\\}}', ' [CIT]', 'g')"
    masked = f"trim(regexp_replace(regexp_replace({tex}, '\\[\\d+(?:\\s*[,;–-]\\s*\\d+)*\\]', '[CIT]', 'g'), '\\s+', ' ', 'g'))"

    def weight(p: str) -> str:
        found = f"regexp_extract(low, '{p}')"
        away = f"abs(strpos(low, {found}) - mark)"
        return f"CASE WHEN {found} = '' THEN NULL WHEN mark = 0 THEN 1.0 WHEN {away} < 30 THEN 2.0 WHEN {away} < 80 THEN 1.5 WHEN {away} < 150 THEN 1.0 ELSE 0.5 END::DOUBLE"

    lists = ", ".join(f"list_filter([{', '.join(map(weight, ps))}], lambda x: x IS NOT NULL) AS l_{k}" for k, ps in C.CUES.items())
    total = lambda c: f"coalesce(list_sum({c}), 0)"
    sums = ", ".join(f"round({total('l_' + k)}, 6) AS s_{k}" for k in C.CUES if k != "contrasting")
    best = "greatest(" + ", ".join(f"s_{k}" for k in C.CUES) + ")"
    name = "CASE " + " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in C.CUES) + " END"
    return f"""WITH m AS (SELECT sentence_id, lower(x) AS low, strpos(x, '[CIT]') AS mark FROM (SELECT sentence_id, {masked} AS x FROM scan_sentences WHERE text IS NOT NULL)),
        l AS (SELECT sentence_id, {lists}, {weight(C.WEAK_CONTRAST)} AS weak FROM m),
        c AS (SELECT *, list_concat(l_contrasting, list_filter([CASE WHEN weak IS NULL THEN NULL WHEN len(l_contrasting) > 0 THEN weak * 0.5 WHEN weak > 1.5 THEN weak * 0.3 END], lambda x: x IS NOT NULL)) AS contrast FROM l),
        s AS (SELECT sentence_id, {sums}, round({total("contrast")} * CASE WHEN coalesce(list_max(contrast), 0) < 1.5 THEN 0.6 ELSE 1.0 END, 6) AS s_contrasting FROM c),
        b AS (SELECT sentence_id, {best} AS best, {name} AS name FROM s)
        SELECT sentence_id, CASE WHEN best = 0 THEN 'mentioning' WHEN name = 'contrasting' THEN 'contrasting' ELSE 'supporting' END AS intent, round(CASE WHEN best = 0 THEN 0.5 ELSE least(0.95, 0.4 + best * 0.15) * CASE name WHEN 'extending' THEN 0.9 WHEN 'using' THEN 0.85 ELSE 1 END END, 6) AS confidence FROM b"""


@query(_intent_sql())
def citation_intent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", C.mark_citations("text").alias("marked"))
    return C.intent(t, "marked").select("sentence_id", "intent", "confidence")


@query(f"SELECT intent, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({_intent_sql()}) GROUP BY intent")
def intent_distribution(spark: SparkSession, d: str) -> DataFrame:
    return citation_intent(spark, d).groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


# A small table of phrases; callers bring their own.
PHRASES = {"glacier runoff": "meltwater discharge", "grain prices": "cereal prices", "bridge sensors": "structural sensors", "legal opinions": "court opinions", "sleep cohorts": "sleep studies"}
PHRASE_PATTERN = "\\b(" + "|".join(p.replace(" ", "\\s+") for p in sorted(PHRASES, key=lambda p: (-len(p), p))) + ")\\b"
HITS = f"SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '{PHRASE_PATTERN}', 1)), '\\s+', ' ', 'g') AS phrase FROM documents WHERE text IS NOT NULL"


@query(
    f"""WITH h AS ({HITS}), s AS (SELECT doc_id, count(*) AS matches, count(DISTINCT phrase) AS different FROM h GROUP BY doc_id),
    x AS (SELECT *, least(100, CASE matches WHEN 1 THEN 30.0 WHEN 2 THEN 55.0 WHEN 3 THEN 70.0 WHEN 4 THEN 80.0 WHEN 5 THEN 90.0 ELSE 90.0 + 2 * (matches - 5) END + 3.0 * different / matches) AS z FROM s)
    SELECT doc_id, matches, different, round(z, 6) AS score, z >= 40 AS suspicious FROM x"""
)
def phrase_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.phrase_score(C.phrase_hits(table(spark, d, "documents").where("text IS NOT NULL"), PHRASES))


GRIM = "mean of (\\d+\\.\\d+) reported by \\S+ can arise from (\\d+) whole"


@query(
    f"""WITH h AS (SELECT item_id, regexp_extract_all(text, '{GRIM}', 1) AS m, regexp_extract_all(text, '{GRIM}', 2) AS n FROM eval_passages), x AS (SELECT item_id, CAST(unnest(m) AS DOUBLE) AS mean, CAST(unnest(n) AS BIGINT) AS n FROM h)
    SELECT item_id, mean, n, abs(mean * n - round_even(mean * n, 0)) <= 0.01 AS consistent FROM x"""
)
def grim_test(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "eval_passages")
    both = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(GRIM), F.lit(k)).alias(n) for k, n in ((1, "m"), (2, "n"))))
    x = p.select("item_id", F.explode(both).alias("z")).select("item_id", F.col("z.m").cast("double").alias("mean"), F.col("z.n").cast("long").alias("n"))
    return x.withColumn("consistent", C.grim(F.col("mean"), F.col("n")))


@query()
def statcheck_p(spark: SparkSession, d: str) -> DataFrame:
    """p-values of every line item read as a test statistic; SQL has no such function."""
    kinds = F.array(*map(F.lit, ("t", "F", "chi2", "r", "Z")))
    k = F.pmod(F.col("l_linenumber"), F.lit(5))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(kinds, k + 1).alias("test"), F.when(k == 3, F.col("l_discount") * 9).otherwise(F.col("l_quantity") / 10).alias("value"), F.col("l_quantity").alias("df1"), (F.col("l_tax") * 100 + 5).alias("df2"))
    return x.select("l_orderkey", "l_linenumber", "test", "value", F.round(p_value("test", "value", "df1", "df2"), 6).alias("p"))


BM25 = """WITH q AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM eval_passages), u AS (SELECT doc_id AS unit, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT unit, w, len(w) AS size FROM u WHERE len(w) > 0),
    t AS (SELECT count(*) AS n, avg(size) AS a FROM s), e AS (SELECT unit, size, unnest(w) AS term FROM s), tf AS (SELECT unit, size, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    z AS (SELECT query, unit, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a))), 4) AS score FROM tf JOIN df USING (term) JOIN q USING (term), t GROUP BY query, unit),
    ranked AS (SELECT query, unit, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, unit) AS INTEGER) AS rank FROM z QUALIFY rank <= 10)"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_passages").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25(q, table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text"), 10)


@query(BM25 + " SELECT * FROM ranked")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d)


GOLD = "(SELECT DISTINCT item_id AS query, doc_id AS unit FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(list_slice(w, k, k + 11), ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_passages) WHERE len(w) >= 12) JOIN (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(list_slice(w, k, k + 11), ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 12) USING (g))"


@query(
    BM25
    + """, gold AS (SELECT * FROM """
    + GOLD
    + """), n AS (SELECT query, count(*) AS n FROM gold GROUP BY query),
    r AS (SELECT r.query, rank, CASE WHEN g.unit IS NULL THEN 0 ELSE 1 END AS r, coalesce(n.n, 0) AS n FROM ranked r LEFT JOIN gold g USING (query, unit) LEFT JOIN n USING (query)), k(k) AS (VALUES (1), (5), (10)),
    pq AS (SELECT k, query, sum(r) AS hits, max(n) AS n, min(CASE WHEN r = 1 THEN rank END) AS first, sum(r / log2(rank + 1)) AS dcg FROM r, k WHERE rank <= k GROUP BY k, query)
    SELECT k, count(*) AS queries, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(sum(hits)::DOUBLE / (k * count(*)), 6) AS "precision", round(sum(hits)::DOUBLE / sum(n), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr,
    round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg FROM pq GROUP BY k"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    e, docs = table(spark, d, "eval_passages"), table(spark, d, "documents")
    gold = R.shared_stretches(e.select(F.col("item_id").alias("query"), "text"), docs.select(F.col("doc_id").alias("unit"), "text"), 12).withColumn("hit", F.lit(True))
    n = gold.groupBy("query").agg(F.count("*").alias("n_relevant"))
    r = ranked(spark, d).join(gold, ["query", "unit"], "left").join(n, "query", "left")
    return E.ranking_metrics(r.select("query", "rank", F.coalesce("hit", F.lit(False)).alias("relevant"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")), [1, 5, 10])

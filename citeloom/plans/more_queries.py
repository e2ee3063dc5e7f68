"""Further queries: spans, hashes, dates, caches, curves and perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import evaluate as E
from citeloom.operators import graph, layout, retrieval
from citeloom.operators import references as R
from citeloom.plans import graph_queries as GQ
from citeloom.plans import score_queries as S
from citeloom.plans import text_queries as T
from citeloom.plans.registry import SQL, query
from citeloom.session import table


@query("SELECT sentence_id, byte_end - byte_start AS stated, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, char_end - char_start = length(text) AS chars_agree FROM scan_sentences WHERE text IS NOT NULL")
def byte_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scan_sentences").where("text IS NOT NULL")
    return s.select("sentence_id", (F.col("byte_end") - F.col("byte_start")).alias("stated"), F.octet_length("text").cast("long").alias("bytes"), (F.col("char_end") - F.col("char_start") == F.length("text")).alias("chars_agree"))


@query(
    "SELECT sentence_id, sha256(c) AS context_sha, substr(sha256(coalesce(bib_key, '') || '|' || pdf_sha256 || '|' || sha256(c)), 1, 16) AS record_id FROM (SELECT *, trim(regexp_replace(replace(lower(text), '~', ' '), '\\s+', ' ', 'g')) AS c FROM scan_sentences WHERE text IS NOT NULL)"
)
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scan_sentences").where("text IS NOT NULL")
    c = F.sha2(X.squeeze(F.replace(F.lower("text"), F.lit("~"), F.lit(" "))), 256)
    return s.select("sentence_id", c.alias("context_sha"), F.substring(F.sha2(F.concat(F.coalesce("bib_key", F.lit("")), F.lit("|"), "pdf_sha256", F.lit("|"), c), 256), 1, 16).alias("record_id"))


QUOTE = "[\"“]([^\"“”]{8,})[\"”]"


@query(f"SELECT sentence_id, unnest(list_filter(regexp_extract_all(text, '{QUOTE}', 1), lambda q: len(str_split(q, ' ')) >= 4)) AS quoted FROM scan_sentences")
def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    q = F.filter(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)), lambda x: F.size(F.split(x, " ")) >= 4)
    return table(spark, d, "scan_sentences").select("sentence_id", F.explode(q).alias("quoted"))


MARK = "\\[(\\d{1,3}(?:\\s*[,-]\\s*\\d{1,3})*)\\]"


@query(
    f"""WITH m AS (SELECT sentence_id, unnest(regexp_extract_all(text, '{MARK}', 1)) AS spec FROM scan_sentences), p AS (SELECT sentence_id, trim(unnest(str_split(spec, ','))) AS part FROM m),
    r AS (SELECT sentence_id, CAST(trim(split_part(part, '-', 1)) AS INTEGER) AS a, CAST(trim(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END) AS INTEGER) AS b FROM p)
    SELECT DISTINCT sentence_id, CAST(unnest(range(a, b + 1)) AS INTEGER) AS label FROM r WHERE b >= a AND b - a <= 50"""
)
def numeric_markers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "scan_sentences").select("sentence_id", F.explode(F.regexp_extract_all("text", F.lit(MARK), F.lit(1))).alias("spec"))
    p = m.select("sentence_id", F.explode(F.split("spec", ",")).alias("part"))
    a = F.trim(F.split_part("part", F.lit("-"), F.lit(1))).cast("int")
    b = F.trim(F.when(F.instr("part", "-") > 0, F.split_part("part", F.lit("-"), F.lit(2))).otherwise(F.col("part"))).cast("int")
    r = p.select("sentence_id", a.alias("a"), b.alias("b")).where("b >= a AND b - a <= 50")
    return r.select("sentence_id", F.explode(F.sequence("a", "b")).alias("label")).distinct()


DATE = "m ->> '$.\"{0}\".\"date-parts\"[0][{1}]'"
ISO = "NULLIF(concat_ws('-', " + DATE.format("{0}", 0) + ", lpad(" + DATE.format("{0}", 1) + ", 2, '0'), lpad(" + DATE.format("{0}", 2) + ", 2, '0')), '')"


@query(T.MESSAGE + f" SELECT raw_id, {ISO.format('issued')} AS issued, {ISO.format('published-print')} AS printed FROM m WHERE m IS NOT NULL")
def answer_dates(spark: SparkSession, d: str) -> DataFrame:
    part = lambda f, k: F.nullif(F.get_json_object("m", f"$.{f}.date-parts[0][{k}]"), F.lit("null"))
    iso = lambda f: F.nullif(F.concat_ws("-", part(f, 0), F.lpad(part(f, 1), 2, "0"), F.lpad(part(f, 2), 2, "0")), F.lit(""))
    return T.messages(spark, d).select("raw_id", iso("issued").alias("issued"), iso("published-print").alias("printed"))


@query(f"SELECT TRY_CAST(substr(printed, 1, 4) AS INTEGER) - TRY_CAST(substr(issued, 1, 4) AS INTEGER) AS gap, count(*) AS n FROM ({SQL['answer_dates']}) GROUP BY gap")
def date_gap_histogram(spark: SparkSession, d: str) -> DataFrame:
    year = lambda c: F.substring(c, 1, 4).try_cast("int")
    return answer_dates(spark, d).groupBy((year("printed") - year("issued")).alias("gap")).agg(F.count("*").alias("n"))


@query("SELECT ref_id, substr(md5('title:' || coalesce(title, '')), 1, 12) AS cache_key FROM bib_references")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_references").select("ref_id", F.substring(F.md5(F.concat(F.lit("title:"), F.coalesce("title", F.lit("")))), 1, 12).alias("cache_key"))


@query(
    "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS calls, count_if(before IS NOT NULL AND epoch_us(ts) - epoch_us(before) <= 3600000000)::BIGINT AS hits FROM e GROUP BY user_id"
)
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a cache whose entries live an hour after their last use would answer."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", "event_id", us.alias("t"))
    e = e.withColumn("before", F.lag("t").over(W.partitionBy("user_id").orderBy("t", "event_id")))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("t") - F.col("before") <= 3_600_000_000).alias("hits"))


@query(f"SELECT count(*) AS refs, count_if(posterior > 0.8 OR posterior < 0.01)::BIGINT AS skipped, round(count_if(posterior > 0.8 OR posterior < 0.01)::DOUBLE / count(*), 6) AS share FROM ({SQL['risk_naive_bayes']})")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    p = S.risk_naive_bayes(spark, d)
    hit = F.count_if((F.col("posterior") > 0.8) | (F.col("posterior") < 0.01))
    return p.agg(F.count("*").alias("refs"), hit.alias("skipped"), F.round(hit / F.count("*"), 6).alias("share"))


@query(
    """WITH r AS (SELECT contradiction_score AS p, coalesce(label = 'CONTRADICTED', false) AS y FROM nli_results WHERE contradiction_score IS NOT NULL), a AS (SELECT p FROM r WHERE y), b AS (SELECT p FROM r WHERE NOT y)
    SELECT (SELECT count(*) FROM a) AS positives, (SELECT count(*) FROM b) AS negatives, round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM a, b) / ((SELECT count(*) FROM a) * (SELECT count(*) FROM b)), 6) AS auc"""
)
def contradiction_auc(spark: SparkSession, d: str) -> DataFrame:
    return E.auc(table(spark, d, "nli_results").withColumn("y", F.coalesce(F.col("label") == "CONTRADICTED", F.lit(False))), "contradiction_score", "y")


@query()
def platt_calibrated(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nli_results").withColumn("y", F.coalesce(F.col("label") == "SUPPORTED", F.lit(False)))
    return E.platt(n, "result_id", "entailment_score", "y")


@query(
    f"""WITH b AS (SELECT r.ref_id, {T._doi("r.doi")} AS d, NULLIF(trim(arxiv_id), '') AS a, title, l.found_by FROM bib_references r LEFT JOIN ({SQL["id_lookup_then_search"]}) l USING (ref_id))
    SELECT ref_id, 'phantom_doi' AS flag, CASE WHEN found_by IS NULL THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM b WHERE d IS NOT NULL AND found_by IS DISTINCT FROM 'doi'
    UNION ALL SELECT ref_id, 'phantom_arxiv', 0.9 FROM b WHERE a IS NOT NULL AND d IS NULL AND found_by IS NULL UNION ALL SELECT ref_id, 'no_match', 0.7 FROM b WHERE length(title) >= 10 AND found_by IS NULL"""
)
def hallucination_flags(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "bib_references").select("ref_id", X.clean_doi("doi").alias("d"), X.present("arxiv_id").alias("a"), "title").join(T.id_lookup_then_search(spark, d).select("ref_id", "found_by"), "ref_id", "left")
    lost = F.col("found_by").isNull()
    flags = F.array(
        F.when(F.col("d").isNotNull() & ~F.col("found_by").eqNullSafe("doi"), F.struct(F.lit("phantom_doi").alias("flag"), F.when(lost, 0.95).otherwise(0.85).alias("confidence"))),
        F.when(F.col("a").isNotNull() & F.col("d").isNull() & lost, F.struct(F.lit("phantom_arxiv").alias("flag"), F.lit(0.9).alias("confidence"))), F.when((F.length("title") >= 10) & lost, F.struct(F.lit("no_match").alias("flag"), F.lit(0.7).alias("confidence"))),
    )
    return r.select("ref_id", F.explode(F.array_compact(flags)).alias("f")).select("ref_id", "f.*")


@query("SELECT doi, count(*) AS n FROM crossref_raw WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crossref_raw").where("doi IS NOT NULL").groupBy("doi").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"SELECT ref_id, y AS year, y + CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END * CAST(2 + h // 2 % 4 AS INTEGER) AS shifted FROM (SELECT ref_id, {T.YEAR.format('year')} AS y, CAST('0x' || substr(md5(CAST(ref_id AS VARCHAR)), 1, 6) AS INTEGER) AS h FROM bib_references) WHERE y IS NOT NULL"
)
def shifted_years(spark: SparkSession, d: str) -> DataFrame:
    """Years moved by two to five either way, the same for an id on every run."""
    h = F.conv(F.substring(F.md5(F.col("ref_id").cast("string")), 1, 6), 16, 10).cast("int")
    r = table(spark, d, "bib_references").select("ref_id", X.first_year("year").alias("year"), h.alias("h")).where("year IS NOT NULL")
    move = F.when(F.col("h") % 2 == 0, 1).otherwise(-1) * (F.lit(2) + F.floor(F.col("h") / 2).cast("int") % 4)
    return r.select("ref_id", "year", (F.col("year") + move).cast("int").alias("shifted"))


@query("SELECT sentence_id, CASE " + " ".join(f"WHEN regexp_matches(lower(masked), '{p}') THEN '{k}'" for k, p in S.C.CLAIM_TYPES.items()) + f" ELSE 'other' END AS claim_type FROM ({SQL['citations_masked']})")
def claim_types(spark: SparkSession, d: str) -> DataFrame:
    return T.citations_masked(spark, d).select("sentence_id", S.C.claim_type(F.col("masked")).alias("claim_type"))


@query("SELECT pdf_sha256, min(ref_index) AS first_index, max(ref_index) AS last_index, count(*) AS entries, count(DISTINCT ref_index) AS places FROM pdf_ref_entries GROUP BY pdf_sha256")
def entry_lists(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "pdf_ref_entries").groupBy("pdf_sha256")
    return g.agg(F.min("ref_index").alias("first_index"), F.max("ref_index").alias("last_index"), F.count("*").alias("entries"), F.count_distinct("ref_index").alias("places"))


@query()
def passages_without_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every document, the longest first, without those that share lines with one kept."""
    w = T.line_windows(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.col("line_end") - F.col("line_start")), "window_no")))
    return layout.without_overlap(w.select("doc_id", "rank", F.lit("text").alias("file"), "line_start", "line_end"), "doc_id")


NAMES = ["reference_not_found", "metadata_mismatch", "no_id_match", "temporal_anomaly", "claim_unsupported"]


@query(S.SIGNALS_SQL + " SELECT ref_id, " + ", ".join(f"max(CASE WHEN signal_name = '{n}' AND fired THEN 1 ELSE 0 END)::INTEGER AS {n}" for n in NAMES) + " FROM signals GROUP BY ref_id")
def signal_matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.S.matrix(S.signals_of(spark, d), NAMES)


@query()
def logistic_lr(spark: SparkSession, d: str) -> DataFrame:
    s = S.signals_of(spark, d)
    bad = s.where("signal_name = 'claim_contradicted'").select("ref_id", F.col("fired").alias("bad"))
    return S.S.logistic_ratios(S.S.matrix(s, NAMES).join(bad, "ref_id"), NAMES, "bad")


@query(f"SELECT a.tier AS naive, b.tier AS grouped, c.tier AS dempster, count(*) AS n FROM ({SQL['risk_naive_bayes']}) a JOIN ({SQL['risk_grouped_bayes']}) b USING (ref_id) JOIN ({SQL['risk_dempster_shafer']}) c USING (ref_id) GROUP BY ALL")
def scorer_comparison(spark: SparkSession, d: str) -> DataFrame:
    tier = lambda q, n: q(spark, d).select("ref_id", F.col("tier").alias(n))
    t = tier(S.risk_naive_bayes, "naive").join(tier(S.risk_grouped_bayes, "grouped"), "ref_id").join(tier(S.risk_dempster_shafer, "dempster"), "ref_id")
    return t.groupBy("naive", "grouped", "dempster").agg(F.count("*").alias("n"))


@query(
    S.SIGNALS_SQL
    + f""", one AS (SELECT ref_id, max(lr_pos) AS lr, count(*) AS fired FROM known WHERE fired GROUP BY ref_id HAVING count(*) >= 2), z AS (SELECT ref_id, 1 / (1 + exp(-({S.ODDS} + ln(lr)))) AS p FROM one),
    f AS (SELECT ref_id, 1 / (1 + exp(-({S.ODDS} + sum(llr)))) AS p FROM known GROUP BY ref_id) SELECT {S.TIER.format("z.p")} AS single, {S.TIER.format("f.p")} AS fused, count(*) AS n FROM z JOIN f USING (ref_id) GROUP BY ALL"""
)
def tier_flips(spark: SparkSession, d: str) -> DataFrame:
    """References with several signals: the tier of the strongest one against that of all."""
    s = S.signals_of(spark, d)
    defs = S.S.definitions(spark)
    strongest = s.where("fired").join(F.broadcast(defs), "signal_name").groupBy("ref_id").agg(F.max("lr_pos").alias("lr"), F.count("*").alias("k")).where("k >= 2")
    p = 1 / (1 + F.exp(-(F.lit(S.ODDS) + F.log("lr"))))
    fused = S.S.naive_bayes(s, defs).select("ref_id", F.col("tier").alias("fused"))
    return strongest.select("ref_id", S.S.tier(p).alias("single")).join(fused, "ref_id").groupBy("single", "fused").agg(F.count("*").alias("n"))


GRID = [round(0.2 + 0.1 * k, 1) for k in range(7)]


@query(
    "WITH g(e) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in GRID) + "), h AS (SELECT a.e AS ent, b.e AS con FROM g a, g b), r AS (SELECT entailment_score AS e, contradiction_score AS c, label FROM nli_results) "
    "SELECT ent, con, round(avg(CASE WHEN CASE WHEN c > con THEN 'CONTRADICTED' WHEN e > ent THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_INFO' END = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r, h GROUP BY ent, con"
)
def nli_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of every pair of thresholds, in one pass over the results."""
    right = lambda e, c: F.avg((F.when(F.col("contradiction_score") > c, "CONTRADICTED").when(F.col("entailment_score") > e, "SUPPORTED").otherwise("NOT_ENOUGH_INFO") == F.col("label")).cast("double"))
    cells = [(e, c) for e in GRID for c in GRID]
    one = table(spark, d, "nli_results").agg(*(F.round(right(e, c), 6).alias(f"a{k}") for k, (e, c) in enumerate(cells)))
    rows = F.array(*(F.struct(F.lit(e).alias("ent"), F.lit(c).alias("con"), F.col(f"a{k}").alias("accuracy")) for k, (e, c) in enumerate(cells)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "SELECT sentence_id, CASE WHEN len(regexp_extract_all(text, '&')) >= 3 OR len(regexp_extract_all(text, '\\\\\\\\')) >= 2 THEN 0.3 WHEN contains(text, '\\begin{tab') OR len(regexp_extract_all(text, '[A-Za-z]{2,}')) < 0.5 * len(regexp_extract_all(text, '\\S+')) THEN 0.6 ELSE 1.0 END::DOUBLE AS penalty FROM scan_sentences WHERE text IS NOT NULL"
)
def tabular_penalties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", retrieval.tabular_penalty(F.col("text")).alias("penalty"))


@query(
    """WITH c AS (SELECT entry_id AS id, unnest(regexp_extract_all(raw, '(\\p{L}{2,}- \\p{Ll}{2,})', 1)) AS c FROM pdf_ref_entries), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '\\p{L}{2,}')) AS word FROM bib_references)
    SELECT id, split_part(c, '- ', 1) AS "left", split_part(c, '- ', 2) AS "right", v.word IS NOT NULL AS joined FROM c LEFT JOIN v ON v.word = lower(replace(c, '- ', ''))"""
)
def hyphen_breaks(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "bib_references").select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word")).distinct()
    return R.hyphen_breaks(table(spark, d, "pdf_ref_entries").select(F.col("entry_id").alias("id"), F.col("raw").alias("text")), words)


@query()
def list_matches(spark: SparkSession, d: str) -> DataFrame:
    """References of a paper's metadata against those of its text, each taken once."""
    m = table(spark, d, "sneaked_matches").select("paper_doi", F.col("match_id").alias("id"), "doi", "title", "match_type")
    return R.greedy_matches(m.where("match_type <> 'text_only'"), m.where("match_type <> 'metadata_only'"), "paper_doi")


@query(
    GQ.STRONG.replace("WITH ", "WITH RECURSIVE ", 1).replace("(SELECT src, dst FROM n WHERE n >", "(SELECT src, dst FROM n WHERE n > 1.05 *")
    + ", r(id, steps) AS (SELECT 0, 0 UNION SELECT s.dst, r.steps + 1 FROM r JOIN s ON s.src = r.id WHERE r.steps < 12) SELECT id, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY id"
)
def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(GQ.strong(spark, d, 1.05), spark.createDataFrame([(0,)], "id int"))

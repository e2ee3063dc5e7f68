"""Queries of names, identifiers, candidates, evaluations by label and dates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import fusion as S
from citeloom.operators import verify as V
from citeloom.plans import claim_queries as CQ
from citeloom.plans import score_queries as SQ
from citeloom.plans import text_queries as T
from citeloom.plans import verify_queries as VQ
from citeloom.plans.registry import SQL, query
from citeloom.session import table

LONGEST = "list_extract(list_sort(list_transform(regexp_extract_all(strip_accents(lower(x)), '[a-z]+'), lambda t: struct_pack(l := -length(t), t := t))), 1).t"


@query(f"SELECT DISTINCT x AS name, trim(regexp_replace(x, '\\s+\\d{{4}}$', '')) AS bare, strip_accents(lower(x)) AS folded, {LONGEST} AS family, regexp_matches(coalesce({LONGEST}, ''), '^.{{4,}}$') AND regexp_matches(coalesce({LONGEST}, ''), '[aeiouy]') AS informative FROM (SELECT unnest(authors) AS x FROM registry_works)")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names without a number behind them, without accents, their longest word, and whether that says much."""
    n = table(spark, d, "registry_works").select(F.explode("authors").alias("name")).distinct()
    words = F.regexp_extract_all(X.fold_accents("name"), F.lit("([a-z]+)"), F.lit(1))
    family = F.get(F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), F.lit(0)).t
    f = F.coalesce(family, F.lit(""))
    return n.select("name", F.trim(F.regexp_replace("name", r"\s+\d{4}$", "")).alias("bare"), X.fold_accents("name").alias("folded"), family.alias("family"), ((F.length(f) >= 4) & f.rlike("[aeiouy]")).alias("informative"))


@query(
    f"""SELECT ref_id, CAST(len(ids) AS INTEGER) AS n, ids[1].t AS first_type, list_filter(ids, lambda i: i.t = 'arxiv')[1].v AS arxiv FROM (SELECT ref_id, list_filter([struct_pack(t := 'doi', v := lower({T._doi("doi")})), struct_pack(t := 'arxiv', v := NULLIF(trim(arxiv_id), '')), struct_pack(t := 'url', v := NULLIF(trim(url), ''))], lambda i: i.v IS NOT NULL) AS ids FROM bib_references)"""
)
def external_ids(spark: SparkSession, d: str) -> DataFrame:
    """All identifiers of a reference, each once, and the first of a kind."""
    each = (("doi", F.lower(X.clean_doi("doi"))), ("arxiv", X.present("arxiv_id")), ("url", X.present("url")))
    ids = F.array_distinct(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("t"), v.alias("v"))) for k, v in each))))
    r = table(spark, d, "bib_references").select("ref_id", ids.alias("ids"))
    return r.select("ref_id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).t.alias("first_type"), F.get(F.filter("ids", lambda i: i.t == "arxiv"), F.lit(0)).v.alias("arxiv"))


@query("SELECT work_id, title, array_to_string(authors, ' | ') AS authors, year, venue FROM registry_works WHERE trim(title) <> ''")
def entity_json(spark: SparkSession, d: str) -> DataFrame:
    """Entities written as JSON and read back; those without a title are none."""
    w = table(spark, d, "registry_works").select("work_id", F.to_json(F.struct("title", "authors", "year", "venue")).alias("j"))
    back = w.select("work_id", F.from_json("j", "title string, authors array<string>, year string, venue string").alias("e")).select("work_id", "e.*").where(F.trim("title") != "")
    return back.withColumn("authors", F.nullif(F.array_join("authors", " | "), F.lit("")))


@query(VQ.MATCHES + f" SELECT ref_id, registry, match_score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY match_score DESC, {VQ.ORDER}, registry, by_id) AS place FROM sm) WHERE place <= 3")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best sources of each reference; ties in the order registries are asked."""
    order = F.coalesce(*(F.when(F.col("registry") == n, F.lit(k)) for k, n in enumerate(V.PRIORITY)), F.lit(len(V.PRIORITY)))
    w = W.partitionBy("ref_id").orderBy(F.desc("match_score"), order, "registry", "by_id")
    return VQ.matches_of(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("ref_id", "registry", "match_score", "place")


@query(VQ.SEARCH + ", b AS (SELECT ref_id, max(likeness) AS likeness FROM best GROUP BY ref_id) SELECT r.ref_id, CASE WHEN likeness >= 0.85 THEN 'VERIFIED' WHEN likeness IS NOT NULL THEN 'SUSPICIOUS' ELSE 'NOT_FOUND' END AS verdict FROM r LEFT JOIN b USING (ref_id)")
def baseline_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What a search for the title alone would say of each reference."""
    refs = VQ.references(spark, d)
    b = V.search(refs, table(spark, d, "registry_works")).groupBy("ref_id").agg(F.max("likeness").alias("likeness"))
    verdict = F.when(F.col("likeness") >= 0.85, "VERIFIED").when(F.col("likeness").isNotNull(), "SUSPICIOUS").otherwise("NOT_FOUND")
    return refs.select("ref_id").join(b, "ref_id", "left").select("ref_id", verdict.alias("verdict"))


TIGHT = "ka = kb OR ((contains(ka, kb) OR contains(kb, ka)) AND abs(length(ka) - length(kb)) < 15) OR (likeness >= 0.85 AND len(str_split(ka, ' ')) >= 5 AND len(str_split(kb, ' ')) >= 5)"


@query(VQ.SEARCH + f", k AS (SELECT ref_id, work_id, likeness, {T.KEY.format('r.title')} AS ka, {T.KEY.format('w.title')} AS kb FROM best JOIN r USING (ref_id) JOIN w USING (work_id)) SELECT ref_id, work_id, {TIGHT} AS tight FROM k")
def tight_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a hit's title is the reference's beyond doubt: equal, contained but for a few letters, or nearly all words of five and more."""
    refs, works = VQ.references(spark, d), table(spark, d, "registry_works")
    k = V.search(refs, works).join(refs.select("ref_id", X.title_key("title").alias("ka")), "ref_id").join(works.select("work_id", X.title_key("title").alias("kb")), "work_id")
    a, b = F.col("ka"), F.col("kb")
    inside = (a.contains(b) | b.contains(a)) & (F.abs(F.length(a) - F.length(b)) < 15)
    many = (F.col("likeness") >= 0.85) & (F.size(F.split(a, " ")) >= 5) & (F.size(F.split(b, " ")) >= 5)
    return k.select("ref_id", "work_id", ((a == b) | inside | many).alias("tight"))


@query(f"WITH c AS ({SQL['citation_claims']}), k AS (SELECT sentence_id, CAST(regexp_extract(cite_key, '^(\\d+)$', 1) AS INTEGER) AS n, pdf_sha256 FROM c JOIN scan_sentences USING (sentence_id) WHERE regexp_matches(cite_key, '^\\d{{1,6}}$')) SELECT sentence_id, n, min(entry_id) AS entry_id FROM k JOIN pdf_ref_entries e ON e.pdf_sha256 = k.pdf_sha256 AND e.ref_index = n GROUP BY sentence_id, n")
def claim_references(spark: SparkSession, d: str) -> DataFrame:
    """The entry of the paper's list that a numbered mark of a claim stands for; the first where a list was read twice."""
    c = CQ.citation_claims(spark, d).where(F.col("cite_key").rlike(r"^\d{1,6}$")).select("sentence_id", F.col("cite_key").cast("int").alias("n")).distinct()
    paper = table(spark, d, "scan_sentences").select("sentence_id", "pdf_sha256")
    first = table(spark, d, "pdf_ref_entries").groupBy("pdf_sha256", F.col("ref_index").alias("n")).agg(F.min("entry_id").alias("entry_id"))
    return c.join(paper, "sentence_id").join(first, ["pdf_sha256", "n"]).select("sentence_id", "n", "entry_id")


@query(
    T.MESSAGE
    + f""", a AS (SELECT lower({T._doi("c.doi")}) AS d, m.raw_id, m.m ->> '$.abstract' AS abstract FROM m JOIN crossref_raw c USING (raw_id)), f AS (SELECT d, min(raw_id) AS raw_id FROM a WHERE d IS NOT NULL AND length(abstract) > 50 GROUP BY d)
    SELECT ref_id, f.raw_id FROM bib_references r JOIN f ON lower({T._doi("r.doi")}) = f.d"""
)
def abstracts_found(spark: SparkSession, d: str) -> DataFrame:
    """The first answer with an abstract of more than 50 characters for each reference's DOI."""
    raw = table(spark, d, "crossref_raw").select("raw_id", F.lower(X.clean_doi("doi")).alias("d"))
    a = T.messages(spark, d).select("raw_id", F.get_json_object("m", "$.abstract").alias("abstract")).where(F.length("abstract") > 50)
    first = a.join(raw, "raw_id").where("d IS NOT NULL").groupBy("d").agg(F.min("raw_id").alias("raw_id"))
    return table(spark, d, "bib_references").select("ref_id", F.lower(X.clean_doi("doi")).alias("d")).join(first, "d").select("ref_id", "raw_id")


@query("WITH x AS (SELECT result_id, [entailment_score, neutral_score, contradiction_score] AS s FROM nli_results WHERE entailment_score IS NOT NULL AND neutral_score IS NOT NULL AND contradiction_score IS NOT NULL), e AS (SELECT result_id, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM x) SELECT result_id, round(e[1] / list_sum(e), 6) AS entailment, round(e[2] / list_sum(e), 6) AS neutral, round(e[3] / list_sum(e), 6) AS contradiction FROM e")
def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    names = ("entailment", "neutral", "contradiction")
    n = table(spark, d, "nli_results").where(" AND ".join(f"{k}_score IS NOT NULL" for k in names))
    top = F.greatest(*(f"{k}_score" for k in names))
    e = n.select("result_id", *(F.exp(F.col(f"{k}_score") - top).alias(k) for k in names))
    total = F.col("entailment") + F.col("neutral") + F.col("contradiction")
    return e.select("result_id", *(F.round(F.col(k) / total, 6).alias(k) for k in names))


# evaluation of the fused risk against contradicted claims
TRUTH = SQ.SIGNALS_SQL + f", risk AS (SELECT ref_id, round(1 / (1 + exp(-({SQ.ODDS} + sum(llr)))), 6) AS p FROM known WHERE signal_name NOT LIKE 'claim%' GROUP BY ref_id), e AS (SELECT ref_id, entry_type, p, coalesce(con, false) AS bad FROM risk JOIN bib_references USING (ref_id) LEFT JOIN nli USING (ref_id))"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """(ref_id, entry_type, p, bad): risk without claims, and whether a claim was contradicted."""
    s = SQ.signals_of(spark, d)
    bad = s.where("signal_name = 'claim_contradicted'").select("ref_id", F.col("fired").alias("bad"))
    risk = S.naive_bayes(s.where("signal_name NOT LIKE 'claim%'"), S.definitions(spark)).select("ref_id", F.col("posterior").alias("p"))
    return risk.join(bad, "ref_id").join(table(spark, d, "bib_references").select("ref_id", "entry_type"), "ref_id")


@query(TRUTH + ", c AS (SELECT count_if(p >= 0.2 AND bad)::BIGINT AS tp, count_if(p >= 0.2 AND NOT bad)::BIGINT AS fp, count_if(p < 0.2 AND bad)::BIGINT AS fn, count_if(p < 0.2 AND NOT bad)::BIGINT AS tn FROM e) SELECT *, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well a high tier foretells a contradicted claim."""
    hit = F.col("p") >= 0.2
    c = evaluated(spark, d).agg(F.count_if(hit & F.col("bad")).alias("tp"), F.count_if(hit & ~F.col("bad")).alias("fp"), F.count_if(~hit & F.col("bad")).alias("fn"), F.count_if(~hit & ~F.col("bad")).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("fpr"))


@query(TRUTH + f" SELECT entry_type, count(*) AS n, count_if(p >= 0.5)::BIGINT AS critical, count_if(p >= 0.2)::BIGINT AS high, round(avg(p), 6) AS mean, round(max(p), 6) AS worst FROM e GROUP BY entry_type")
def integrity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Risk by kind of reference."""
    p = F.col("p")
    return evaluated(spark, d).groupBy("entry_type").agg(F.count("*").alias("n"), F.count_if(p >= 0.5).alias("critical"), F.count_if(p >= 0.2).alias("high"), F.round(F.avg(p), 6).alias("mean"), F.round(F.max(p), 6).alias("worst"))


CONFIGS = {"existence": ("reference_not_found", "no_id_match"), "metadata": ("reference_not_found", "no_id_match", "metadata_mismatch", "temporal_anomaly"), "all": ("reference_not_found", "no_id_match", "metadata_mismatch", "temporal_anomaly", "claim_contradicted", "claim_unsupported")}


@query(
    SQ.SIGNALS_SQL
    + ", cfg(config, s) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, ss in CONFIGS.items() for s in ss)
    + f"), p AS (SELECT config, ref_id, 1 / (1 + exp(-({SQ.ODDS} + sum(llr)))) AS p FROM known JOIN cfg ON s = signal_name GROUP BY config, ref_id) SELECT config, {SQ.TIER.format('p')} AS tier, count(*) AS n FROM p GROUP BY 1, 2"
)
def ablation_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of the same references under signals of ever more layers."""
    pairs = F.array(*(F.struct(F.lit(c).alias("config"), F.array(*map(F.lit, ss)).alias("of")) for c, ss in CONFIGS.items()))
    each = SQ.signals_of(spark, d).select("*", F.explode(pairs).alias("x")).where(F.array_contains("x.of", F.col("signal_name")))
    keyed = each.select(F.concat_ws("|", "x.config", F.col("ref_id").cast("string")).alias("ref_id"), "seq", "signal_name", "fired", "confidence")
    r = S.naive_bayes(keyed, S.definitions(spark))
    return r.select(F.split_part("ref_id", F.lit("|"), F.lit(1)).alias("config"), "tier").groupBy("config", "tier").agg(F.count("*").alias("n"))


@query(SQ.SIGNALS_SQL + ", t AS (SELECT ref_id, max(label) AS truth FROM nli_results GROUP BY ref_id) SELECT truth, signal_name, count(*) AS n, round(avg(CASE WHEN fired THEN 1.0 ELSE 0.0 END), 6) AS rate FROM signals JOIN t USING (ref_id) GROUP BY truth, signal_name")
def fire_rates_by_label(spark: SparkSession, d: str) -> DataFrame:
    """How often each signal fires on references of each label: its false alarms on the supported ones."""
    t = table(spark, d, "nli_results").groupBy("ref_id").agg(F.max("label").alias("truth"))
    return SQ.signals_of(spark, d).join(t, "ref_id").groupBy("truth", "signal_name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("fired").cast("double")), 6).alias("rate"))


@query(
    f"WITH e AS ({SQL['empirical_lr']}), " + SQ.DEFS_SQL
    + " SELECT d.signal_name, CASE WHEN n_bad >= 5 AND n_good >= 5 THEN round(least(e.lr_pos, 100), 2) ELSE d.lr_pos END AS lr_pos, CASE WHEN n_bad >= 5 AND n_good >= 5 THEN round(greatest(0.5, least(1, e.lr_neg)), 4) ELSE d.lr_neg END AS lr_neg FROM defs d LEFT JOIN e USING (signal_name)"
)
def calibrated_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood ratios measured where there are observations enough, the published ones elsewhere."""
    e = SQ.empirical_lr(spark, d).select("signal_name", "n_bad", "n_good", F.col("lr_pos").alias("p"), F.col("lr_neg").alias("q"))
    j = S.definitions(spark).join(e, "signal_name", "left")
    enough = (F.col("n_bad") >= 5) & (F.col("n_good") >= 5)
    return j.select("signal_name", F.when(enough, F.round(F.least("p", F.lit(100.0)), 2)).otherwise(F.col("lr_pos")).alias("lr_pos"), F.when(enough, F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), "q")), 4)).otherwise(F.col("lr_neg")).alias("lr_neg"))


DATES = ("issued", "published-print", "published-online", "created", "deposited")


@query(
    T.MESSAGE
    + ", v AS (" + " UNION ALL ".join(f"SELECT raw_id, '{f}' AS field, TRY_CAST(m ->> '$.\"{f}\".\"date-parts\"[0][0]' AS INTEGER) AS y, TRY_CAST(m ->> '$.issued.\"date-parts\"[0][0]' AS INTEGER) AS i FROM m WHERE m IS NOT NULL" for f in DATES)
    + ") SELECT field, count(*) AS answers, count(y) AS available, coalesce(count_if(abs(y - i) > 2), 0)::BIGINT AS far, coalesce(count_if(y < i), 0)::BIGINT AS earlier, coalesce(count_if(y > i), 0)::BIGINT AS later FROM v GROUP BY field"
)
def date_field_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often answers have each date, and how its year compares with the year of issue."""
    y = lambda f: F.get_json_object("m", f"$.{f}.date-parts[0][0]").try_cast("int")
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), y(f).alias("y")) for f in DATES))).alias("v")
    v = T.messages(spark, d).select(rows, y("issued").alias("i")).select("v.field", "v.y", "i")
    n = lambda c, name: F.count_if(c).alias(name)
    return v.groupBy("field").agg(F.count("*").alias("answers"), F.count("y").alias("available"), n(F.abs(F.col("y") - F.col("i")) > 2, "far"), n(F.col("y") < F.col("i"), "earlier"), n(F.col("y") > F.col("i"), "later"))



@query(
    "WITH q AS (SELECT sentence_id, pdf_sha256, lower(trim(regexp_replace(unnest(regexp_extract_all(text, '[\"“]([^\"“”]{12,})[\"”]', 1)), '\\s+', ' ', 'g'))) AS quote FROM scan_sentences), s AS (SELECT sentence_id, pdf_sha256, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM scan_sentences WHERE text IS NOT NULL) "
    "SELECT q.sentence_id, q.quote, min(s.sentence_id) AS found_in FROM q JOIN s ON q.pdf_sha256 = s.pdf_sha256 AND q.sentence_id <> s.sentence_id AND contains(s.t, q.quote) GROUP BY 1, 2"
)
def located_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotations that another piece of the same paper holds word for word, apart from case and spacing."""
    s = table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", "pdf_sha256", "text")
    q = s.select("sentence_id", "pdf_sha256", F.explode(F.regexp_extract_all("text", F.lit("[\"“]([^\"“”]{12,})[\"”]"), F.lit(1))).alias("q")).select("sentence_id", "pdf_sha256", F.lower(X.squeeze("q")).alias("quote"))
    t = s.select(F.col("sentence_id").alias("other"), "pdf_sha256", F.lower(X.squeeze("text")).alias("t"))
    met = q.join(t, "pdf_sha256").where((F.col("sentence_id") != F.col("other")) & F.contains(F.col("t"), F.col("quote")))
    return met.groupBy("sentence_id", "quote").agg(F.min("other").alias("found_in"))

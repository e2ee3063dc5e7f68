"""Queries of claims, addresses, reported tests and perturbed references, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import claims as C
from citeloom.operators import references as R
from citeloom.operators import retrieval
from citeloom.plans import score_queries as S
from citeloom.plans import text_queries as T
from citeloom.plans.registry import SQL, query
from citeloom.session import table

def _sentences_sql(c: str) -> str:
    cut = f"str_split(regexp_replace({c}, '" + X.SENTENCE_END + "', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: length(x) >= 1)"



@query(f"SELECT sentence_id, CAST(i AS INTEGER) AS sent_no, s[i + 1] AS sentence FROM (SELECT sentence_id, s, unnest(range(len(s))) AS i FROM (SELECT sentence_id, {_sentences_sql('text')} AS s FROM scan_sentences WHERE text IS NOT NULL))")
def sentence_pieces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "scan_sentences").where("text IS NOT NULL")
    return t.select("sentence_id", F.posexplode(X.sentences("text")).alias("sent_no", "sentence"))


def _clean_sql(c: str) -> str:
    for p in C.MARKS:
        c = f"regexp_replace({c}, '\\s*{p}', '', 'g')"
    squeezed = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"regexp_replace(trim(regexp_replace(regexp_replace({squeezed}, '{C.LEAD_IN}', ''), '\\s+', ' ', 'g')), '^[,;:\\s]+', '')"


MARKS_SQL = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(s[i + 1], '{p}', 1)" for p in C.MARKS[:2]) + f"), regexp_extract_all(s[i + 1], '{C.MARKS[2]}', 1))"


@query(
    f"""WITH p AS (SELECT sentence_id, s, unnest(range(len(s))) AS i FROM (SELECT sentence_id, {_sentences_sql("text")} AS s FROM scan_sentences WHERE text IS NOT NULL)),
    k AS (SELECT sentence_id, s, i, unnest(list_distinct({MARKS_SQL})) AS cite_key FROM p), c AS (SELECT sentence_id, CAST(i AS INTEGER) AS sent_no, cite_key, {_clean_sql("s[i + 1]")} AS claim, CASE WHEN i > 0 THEN s[i] END AS "before", s[i + 2] AS "after" FROM k)
    SELECT * FROM c WHERE len(str_split(claim, ' ')) >= 5"""
)
def citation_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.claims(table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", "text"), "sentence_id")


def _address_sql(e: str) -> str:
    local, domain = f"split_part({e}, '@', 1)", f"regexp_extract({e}, '@(.*)$', 1)"
    mills, free = (", ".join(f"'{x}'" for x in xs) for xs in (C.MILL_DOMAINS, C.FREE_PROVIDERS))
    return f"""CASE WHEN {domain} = '' THEN 0 ELSE least(100, CASE WHEN {domain} IN ({mills}) THEN 80 ELSE 0 END + CASE WHEN {domain} IN ({free}) THEN 20 ELSE 0 END + CASE WHEN regexp_matches({local}, '{C.NUMBERED}') OR regexp_matches({local}, '{C.RANDOM}') THEN 15 ELSE 0 END
        + CASE WHEN regexp_matches({domain}, '{C.INSTITUTION}') AND NOT regexp_matches({domain}, '{C.INSTITUTION_TLD}') AND {domain} NOT IN ({mills}) THEN 25 ELSE 0 END) END"""


# addresses made of names: the tables hold few
ADDRESSES_SQL = """WITH a AS (SELECT s_suppkey AS id, s_nationkey AS list, lower(replace(s_name, '#', '')) || '@' || CASE s_suppkey % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'qq.com' WHEN 2 THEN 'med.uni.ac.uk' WHEN 3 THEN 'city-hospital.com' WHEN 4 THEN 'fastpublish.net' ELSE 'firm.example' END AS email FROM supplier
    UNION ALL SELECT -s_suppkey, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'wang' || s_suppkey || '77@163.com' WHEN 1 THEN 'xkcdq@mail.ru' ELSE 'nobody' END FROM supplier)"""


def addresses(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("list"), "s_name")
    pick = lambda n, xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("k") % n + 1).cast("int"))
    named = F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit("@"), pick(6, ["gmail.com", "qq.com", "med.uni.ac.uk", "city-hospital.com", "fastpublish.net", "firm.example"]))
    other = F.when(F.col("k") % 3 == 0, F.concat(F.lit("wang"), "k", F.lit("77@163.com"))).when(F.col("k") % 3 == 1, "xkcdq@mail.ru").otherwise("nobody")
    return s.select(F.col("k").alias("id"), "list", named.alias("email")).unionByName(s.select((-F.col("k")).alias("id"), "list", other.alias("email")))


@query(ADDRESSES_SQL + f" SELECT id, email, CAST({_address_sql('lower(trim(email))')} AS INTEGER) AS risk FROM a")
def address_risk(spark: SparkSession, d: str) -> DataFrame:
    return addresses(spark, d).select("id", "email", C.email_risk("email").cast("int").alias("risk"))


@query(
    ADDRESSES_SQL
    + f""", r AS (SELECT list, {_address_sql("lower(trim(email))")} AS risk, CASE WHEN regexp_extract(email, '@(.*)$', 1) IN ({", ".join(f"'{x}'" for x in C.FREE_PROVIDERS)}) THEN regexp_extract(email, '@(.*)$', 1) END AS free, regexp_extract(email, '@(.*)$', 1) IN ({", ".join(f"'{x}'" for x in C.MILL_DOMAINS)}) AS mill FROM a),
    g AS (SELECT list, count(*) AS addresses, count(free) AS free, count_if(mill)::BIGINT AS mills, max(risk) AS worst, count(DISTINCT free) AS kinds FROM r GROUP BY list)
    SELECT list, addresses, free, mills, CAST(least(100, worst + CASE WHEN free > 1 THEN 10 * (free - 1) ELSE 0 END + CASE WHEN free >= 2 AND kinds = 1 AND free = addresses THEN 15 ELSE 0 END) AS INTEGER) AS score FROM g"""
)
def address_lists(spark: SparkSession, d: str) -> DataFrame:
    return C.email_lists(addresses(spark, d), "list")


# reports of tests written from line items, for the texts hold none
REPORT_SQL = "'On day ' || l_linenumber || ', t(' || CAST(l_quantity AS INTEGER) || ') = ' || CAST(round(l_tax * 50, 2) AS DECIMAL(9,2)) || ', p = .' || lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) + 1 AS VARCHAR), 2, '0') || '. F(2, ' || (CAST(l_quantity AS INTEGER) + 4) || ') = ' || CAST(round(l_discount * 60, 2) AS DECIMAL(9,2)) || ', p < 0.05; Z = -' || CAST(round(l_tax * 30, 2) AS DECIMAL(9,2)) || ', p > .1'"


def reports(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.round(c, 2).cast("decimal(9,2)").cast("string")
    q = F.col("l_quantity").cast("int")
    text = F.concat(
        F.lit("On day "), F.col("l_linenumber").cast("string"), F.lit(", t("), q.cast("string"), F.lit(") = "), two(F.col("l_tax") * 50), F.lit(", p = ."), F.lpad((F.round(F.col("l_discount") * 100).cast("int") + 1).cast("string"), 2, "0"),
        F.lit(". F(2, "), (q + 4).cast("string"), F.lit(") = "), two(F.col("l_discount") * 60), F.lit(", p < 0.05; Z = -"), two(F.col("l_tax") * 30), F.lit(", p > .1"),
    )
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))


def _tests_sql() -> str:
    parts = []
    for name, (p, g) in C.TESTS.items():
        some = next(x for x in g if x)
        cols = ", ".join(f"unnest(regexp_extract_all(text, '{p}', {x or some})) AS {n}" for n, x in zip(("a", "b", "s", "p"), g))
        num = lambda n, x: f"CAST({n} AS DOUBLE)" if x else "0.0::DOUBLE"
        parts.append(f"SELECT id, '{name}' AS test, {num('a', g[0])} AS df1, {num('b', g[1])} AS df2, CAST(s AS DOUBLE) AS statistic, round(least(1, CASE WHEN CAST(p AS DOUBLE) >= 1 THEN CAST(p AS DOUBLE) / pow(10, length(p)) ELSE CAST(p AS DOUBLE) END), 6) AS p FROM (SELECT id, {cols} FROM t)")
    return f"WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, {REPORT_SQL} AS text FROM lineitem) " + " UNION ALL ".join(parts)


@query(_tests_sql())
def reported_tests(spark: SparkSession, d: str) -> DataFrame:
    return C.reported_tests(reports(spark, d), "id").select("id", "test", "df1", "df2", "statistic", F.round("p", 6).alias("p"))


@query()
def statistical_risk(spark: SparkSession, d: str) -> DataFrame:
    """Reported tests recomputed: errors, decision errors and risk of every report; SQL has no p-values."""
    c = C.check_tests(C.reported_tests(reports(spark, d), "id"))
    g = c.groupBy("id").agg(F.count("*").alias("tests"), F.count_if(~F.col("consistent")).alias("errors"), F.count_if("decision_error").alias("decision_errors"))
    return g.withColumn("risk", F.least(F.lit(100), C.STAT_POINTS[1] * F.col("errors") + C.STAT_POINTS[2] * F.col("decision_errors")))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS mean, abs(round_even(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 * l_quantity, 0) / l_quantity - floor(l_extendedprice / l_quantity * 100 + 0.5) / 100) <= 0.005 + 1e-9 AS possible FROM lineitem")
def grim_rounded(spark: SparkSession, d: str) -> DataFrame:
    mean = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mean.alias("mean"), C.grim_rounded(mean, F.col("l_quantity"), 1, 2).alias("possible"))


STOPS = ", ".join(f"'{w}'" for w in X.SEARCH_STOP)


@query(
    f"""WITH m AS (SELECT sentence_id, regexp_replace(replace(masked, '[CIT]', ' '), '\\\\[a-zA-Z]+\\*?(?:\\[[^\\]]*\\])?(?:\\{{([^}}]*)\\}})?', ' \\1 ', 'g') AS s FROM ({SQL["citations_masked"]})),
    w AS (SELECT sentence_id, list_filter(regexp_extract_all(s, '([A-Za-z][A-Za-z0-9-]{{2,}}|[0-9]+(?:\\.[0-9]+)?)', 1), lambda w: lower(w) NOT IN ({STOPS})) AS w FROM m),
    e AS (SELECT sentence_id, list_transform(w, lambda x: lower(x)) AS low, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
    o AS (SELECT sentence_id, x, row_number() OVER (PARTITION BY sentence_id ORDER BY CASE WHEN regexp_matches(x, '^[0-9]') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(x, '^[A-Z]') THEN 0 ELSE 1 END, -length(x), i) AS r FROM e WHERE list_position(low, lower(x)) = i)
    SELECT sentence_id, coalesce(string_agg(x, ' ' ORDER BY r), '') AS terms FROM (SELECT sentence_id FROM w) LEFT JOIN (SELECT * FROM o WHERE r <= 16) USING (sentence_id) GROUP BY sentence_id"""
)
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 16 terms of a citing sentence that narrow a search most."""
    return table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", F.array_join(X.search_terms("text"), " ").alias("terms"))


def _asides_sql(c: str, depth: int = 4) -> str:
    for _ in range(depth):
        c = f"regexp_replace({c}, '\\s*\\((?:[^()\\[]|\\[[^C])*\\)', '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(
    f"SELECT sentence_id, {_asides_sql('masked')} AS plain, CASE WHEN len(str_split(trim(regexp_replace(masked, '\\s+', ' ', 'g')), ' ')) <= 20 THEN masked ELSE array_to_string(list_slice(str_split(trim(regexp_replace(masked, '\\s+', ' ', 'g')), ' '), 1, 20), ' ') || ' …' END AS clipped, regexp_replace(masked, '(1[89]|20)\\d\\d', '####', 'g') AS yearless, "
    f"CAST(len(list_slice(list_filter({_sentences_sql('masked')}, lambda s: length(s) > 20), 1, 10)) AS INTEGER) AS long_sentences FROM ({SQL['citations_masked']})"
)
def sentence_cleaners(spark: SparkSession, d: str) -> DataFrame:
    """Citing sentences without asides, clipped, with years masked, and how many long sentences they hold."""
    m = T.citations_masked(spark, d)
    return m.select("sentence_id", X.without_asides("masked").alias("plain"), X.clip_words("masked", 20).alias("clipped"), F.regexp_replace("masked", r"(1[89]|20)\d\d", "####").alias("yearless"), F.size(F.slice(X.sentences("masked", 21), 1, 10)).alias("long_sentences"))


@query("SELECT pdf_sha256, count(*) AS results, bool_and(intent = 'mentioning') AS fired, 0.7::DOUBLE AS confidence FROM (" + SQL["citation_intent"] + ") JOIN scan_sentences USING (sentence_id) GROUP BY pdf_sha256 HAVING count(*) >= 3")
def all_mentioning(spark: SparkSession, d: str) -> DataFrame:
    """Papers of which every citing sentence only mentions: a signal of the set, not of one reference."""
    i = S.citation_intent(spark, d).join(table(spark, d, "scan_sentences").select("sentence_id", "pdf_sha256"), "sentence_id")
    return i.groupBy("pdf_sha256").agg(F.count("*").alias("results"), F.bool_and(F.col("intent") == "mentioning").alias("fired"), F.lit(0.7).alias("confidence")).where("results >= 3")


@query("SELECT ref_id, count(*) AS claims, count_if(label = 'SUPPORTED')::BIGINT AS supported, count_if(label = 'CONTRADICTED')::BIGINT AS contradicted, count_if(label NOT IN ('SUPPORTED', 'CONTRADICTED'))::BIGINT AS other FROM nli_results GROUP BY ref_id")
def semantic_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, d, "nli_results").groupBy("ref_id").agg(F.count("*").alias("claims"), n(F.col("label") == "SUPPORTED", "supported"), n(F.col("label") == "CONTRADICTED", "contradicted"), n(~F.col("label").isin("SUPPORTED", "CONTRADICTED"), "other"))


@query(
    """WITH c AS (SELECT paper_doi, lower(trim(journal)) AS j, count(*) AS n FROM sneaked_matches WHERE trim(journal) <> '' GROUP BY 1, 2), top AS (SELECT paper_doi, max(n) / sum(n) AS share FROM c GROUP BY 1),
    s AS (SELECT paper_doi, count(*) AS n, avg(CASE WHEN is_sneaked THEN 1.0 ELSE 0.0 END) AS r, bool_or(coalesce(CASE WHEN regexp_matches(year, '^\\s*\\d{1,4}\\s*$') THEN CAST(trim(year) AS INTEGER) END > year(checked_at), false)) AS later FROM sneaked_matches GROUP BY 1)
    SELECT paper_doi, n, CAST(least(100, CASE WHEN r > 0.5 THEN 70 WHEN r > 0.2 THEN 40 ELSE 0 END + CASE WHEN share > 0.3 THEN 20 ELSE 0 END + CASE WHEN later THEN 15 ELSE 0 END) AS INTEGER) AS score,
        CAST(least(100, CASE WHEN share > 0.3 THEN 20 ELSE 0 END + CASE WHEN later THEN 15 ELSE 0 END + CASE WHEN n > 80 THEN 15 ELSE 0 END) AS INTEGER) AS metadata_score FROM s LEFT JOIN top USING (paper_doi)"""
)
def sneaked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Risk of each paper's references by text and metadata, and by metadata alone."""
    m = table(spark, d, "sneaked_matches")
    top = m.where(F.trim("journal") != "").groupBy("paper_doi", F.lower(F.trim("journal")).alias("j")).agg(F.count("*").alias("n")).groupBy("paper_doi").agg((F.max("n") / F.sum("n")).alias("share"))
    year = F.when(F.col("year").rlike(r"^\s*\d{1,4}\s*$"), F.trim("year").cast("int"))
    s = m.groupBy("paper_doi").agg(F.count("*").alias("n"), F.avg(F.coalesce("is_sneaked", F.lit(False)).cast("double")).alias("r"), F.bool_or(F.coalesce(year > F.year("checked_at"), F.lit(False))).alias("later"))
    j = s.join(top, "paper_doi", "left")
    flags = F.when(F.col("share") > 0.3, 20).otherwise(0) + F.when(F.col("later"), 15).otherwise(0)
    ratio = F.when(F.col("r") > 0.5, 70).when(F.col("r") > 0.2, 40).otherwise(0)
    return j.select("paper_doi", "n", F.least(F.lit(100), ratio + flags).alias("score"), F.least(F.lit(100), flags + F.when(F.col("n") > 80, 15).otherwise(0)).alias("metadata_score"))


# Words and names that perturbations bring in.
EXTRA, NAMES = ("novel", "robust", "deep", "unified"), ("Alder, Kim", "Brook, Ines", "Cedar, Jon")
HEX = "CAST(('0x' || substr(md5({0}), {1}, 2)) AS INTEGER)"


@query(
    f"""WITH s AS (SELECT ref_id, str_split(title, ' ') AS w, {HEX.format("CAST(ref_id AS VARCHAR) || ':t'", 1)} % 4 AS op, {HEX.format("CAST(ref_id AS VARCHAR) || ':t'", 3)} AS h, authors, year FROM (SELECT ref_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, {"list_filter(list_transform(regexp_split_to_array(author, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '')"} AS authors, year FROM bib_references WHERE trim(title) <> '')),
    p AS (SELECT *, 1 + h % len(w) AS k, ['{"', '".join(EXTRA)}'][1 + h % {len(EXTRA)}] AS x, ['{"', '".join(NAMES)}'][1 + h % {len(NAMES)}] AS n FROM s)
    SELECT ref_id, ['swap', 'insert', 'drop', 'replace'][op + 1] AS change, array_to_string(CASE op WHEN 0 THEN CASE WHEN k < len(w) THEN list_concat(list_concat(w[1:k - 1], [w[k + 1], w[k]]), w[k + 2:]) ELSE w END WHEN 1 THEN list_concat(list_concat(w[1:k - 1], [x]), w[k:]) WHEN 2 THEN list_concat(w[1:k - 1], w[k + 1:]) ELSE list_concat(list_concat(w[1:k - 1], [x]), w[k + 1:]) END, ' ') AS title,
        coalesce(array_to_string(list_concat([n], authors[2:]), ' and '), n) AS author FROM p"""
)
def perturbed_references(spark: SparkSession, d: str) -> DataFrame:
    """Negatives made from references: one word swapped, put in, dropped or replaced, and another first author; seeded by the id."""
    seed = F.md5(F.concat(F.col("ref_id").cast("string"), F.lit(":t")))
    byte = lambda k: F.conv(F.substring(seed, k, 2), 16, 10).cast("int")
    r = table(spark, d, "bib_references").where(F.trim("title") != "").select("ref_id", F.split(X.squeeze("title"), " ").alias("w"), X.authors("author").alias("authors"), (byte(1) % 4).alias("op"), byte(3).alias("h"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("h") % len(xs) + 1)
    r = r.withColumn("k", F.col("h") % F.size("w") + 1).withColumn("x", F.array(pick(EXTRA)))
    upto, n = F.slice("w", F.lit(1), F.col("k") - 1), F.size("w")
    after = lambda j: F.slice("w", F.col("k") + j, n)
    swapped = F.when(F.col("k") < n, F.concat(upto, F.array(F.try_element_at("w", F.col("k") + 1), F.try_element_at("w", F.col("k"))), after(2))).otherwise(F.col("w"))
    title = F.when(F.col("op") == 0, swapped).when(F.col("op") == 1, F.concat(upto, "x", after(0))).when(F.col("op") == 2, F.concat(upto, after(1))).otherwise(F.concat(upto, "x", after(1)))
    author = F.array_join(F.concat(F.array(pick(NAMES)), F.coalesce(F.slice("authors", F.lit(2), F.greatest(F.size("authors") - 1, F.lit(0))), F.array().cast("array<string>"))), " and ")
    change = F.element_at(F.array(*map(F.lit, ("swap", "insert", "drop", "replace"))), F.col("op") + 1)
    return r.select("ref_id", change.alias("change"), F.array_join(title, " ").alias("title"), author.alias("author"))


STRETCH = 12


@query(
    f"""WITH a AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_passages), b AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    x AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {STRETCH - 2}), lambda k: array_to_string(list_slice(w, k, k + {STRETCH - 1}), ' '))) AS g FROM a WHERE len(w) >= {STRETCH}), y AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {STRETCH - 2}), lambda k: array_to_string(list_slice(w, k, k + {STRETCH - 1}), ' '))) AS g FROM b WHERE len(w) >= {STRETCH})
    SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (g)"""
)
def relevant_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a stretch of twelve words of a test item: what a search for the item should find."""
    return R.shared_stretches(table(spark, d, "eval_passages").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"), STRETCH)


FACTOR_SQL = "(1 + 0.25 * least(4, " + " + ".join(f"CASE WHEN contains(lower(text), '{c}') THEN 1 ELSE 0 END" for c in retrieval.CUES["finding"]) + ")) * CASE WHEN len(regexp_extract_all(text, '&')) >= 3 OR len(regexp_extract_all(text, '\\\\\\\\')) >= 2 THEN 0.3 WHEN contains(text, '\\begin{tab') OR len(regexp_extract_all(text, '[A-Za-z]{2,}')) < 0.5 * len(regexp_extract_all(text, '\\S+')) THEN 0.6 ELSE 1.0 END"
CUED = S.BM25.replace("SELECT doc_id AS unit, regexp_extract_all", f"SELECT doc_id AS unit, {FACTOR_SQL} AS f, regexp_extract_all").replace("SELECT unit, w, len(w) AS size", "SELECT unit, f, w, len(w) AS size").replace("SELECT unit, size, unnest(w)", "SELECT unit, f, size, unnest(w)").replace("SELECT unit, size, term, count(*) AS tf", "SELECT unit, f, size, term, count(*) AS tf").replace("round(sum(ln(", "round(min(f) * sum(ln(")


@query(CUED + " SELECT * FROM ranked")
def bm25_with_cues(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with more for passages that state findings and less for tables."""
    q = table(spark, d, "eval_passages").select(F.col("item_id").alias("query"), "text")
    units = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text", retrieval.cue_factor(F.col("text"), "finding").alias("factor"))
    return retrieval.bm25(q, units, 10)

"""Queries on references, answers and texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.similarity import jaro_winkler
from citeloom.operators import references as R
from citeloom.plans.registry import query
from citeloom.session import table
from citeloom.sources import files
from citeloom.sources.registry import REGISTRIES

# SQL that several checks share
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
DOI = "(CASE WHEN regexp_matches({0}, '^10\\.\\d{{4,}}/\\S+$') THEN {0} END)"
BARE = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '(?i)^(?:(?:https?://)?(?:dx\\.)?doi\\.org/|doi:?\\s*)', '')"
YEAR = "TRY_CAST(NULLIF(regexp_extract({0}, '(1[89]\\d\\d|20\\d\\d|2100)', 1), '') AS INTEGER)"


def _doi(c: str) -> str:
    return DOI.format(BARE.format(c))


WORTH = "CASE {0} WHEN 'OK' THEN 100.0 WHEN 'WARN' THEN 60.0 WHEN 'FAIL' THEN 0.0 END"
YEAR_STATUS = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 'WARN' WHEN abs({0}-{1})=0 THEN 'OK' WHEN abs({0}-{1})<=2 THEN 'WARN' ELSE 'FAIL' END"


@query(
    "SELECT ref_id, CASE "
    + " ".join(f"WHEN regexp_matches(trim(v), '{p}') THEN '{n}'" for n, p in X.ID_TYPES)
    + " END AS id_type FROM (SELECT ref_id, coalesce(NULLIF(trim(doi), ''), NULLIF(trim(arxiv_id), '')) AS v FROM bib_references)"
)
def identifier_type(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "bib_references")
    return refs.select("ref_id", X.id_type(F.coalesce(X.present("doi"), X.present("arxiv_id"))).alias("id_type"))


@query(f"SELECT ref_id, {_doi('doi')} AS doi_clean, NULLIF(regexp_extract(coalesce(arxiv_id, ''), '(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?|[a-z-]+(?:\\.[A-Z]{{2}})?/\\d{{7}}(?:v\\d+)?)', 1), '') AS arxiv FROM bib_references")
def clean_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_references").select("ref_id", X.clean_doi("doi").alias("doi_clean"), X.arxiv_id(F.coalesce("arxiv_id", F.lit(""))).alias("arxiv"))


@query(
    f"""SELECT ref_id, 'ice:' || substr(sha256(CASE WHEN d IS NOT NULL THEN 'doi:' || d WHEN a IS NOT NULL THEN 'arxiv:' || a ELSE 'title:' || t || ':' || coalesce(y, '') END), 1, 12) AS ice_id
    FROM (SELECT ref_id, lower({_doi("doi")}) AS d, NULLIF(trim(arxiv_id), '') AS a, coalesce({KEY.format("title")}, '') AS t, year AS y FROM bib_references)"""
)
def stable_entity_id(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "bib_references").select("ref_id", F.lower(X.clean_doi("doi")).alias("d"), X.present("arxiv_id").alias("a"), F.coalesce(X.title_key("title"), F.lit("")).alias("t"), "year")
    kind = F.when(F.col("d").isNotNull(), "doi").when(F.col("a").isNotNull(), "arxiv").otherwise("title")
    value = F.coalesce("d", "a", F.concat("t", F.lit(":"), F.coalesce("year", F.lit(""))))
    return r.select("ref_id", X.entity_id(kind, value).alias("ice_id"))


@query(
    """SELECT ref_id, CAST(len(a) AS INTEGER) AS authors, NULLIF(list_extract(str_split(trim(regexp_replace(CASE WHEN contains(a[1], ',') THEN split_part(a[1], ',', 1) ELSE a[1] END, '\\s+', ' ', 'g')), ' '), -1), NULL) AS first_surname
    FROM (SELECT ref_id, list_filter(list_transform(regexp_split_to_array(author, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM bib_references WHERE author IS NOT NULL)"""
)
def author_surnames(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "bib_references").where("author IS NOT NULL").select("ref_id", X.authors("author").alias("a"))
    return r.select("ref_id", F.size("a").alias("authors"), X.surname(F.try_element_at("a", F.lit(1))).alias("first_surname"))


@query(
    "SELECT v AS venue_name, count(*) AS n FROM (SELECT CASE "
    + " ".join(f"WHEN starts_with(l, '{a}') THEN '{b}'" for a, b in X.VENUES)
    + " ELSE l END AS v FROM (SELECT trim(regexp_replace(lower(venue), '\\s+', ' ', 'g')) AS l FROM bib_references WHERE venue IS NOT NULL)) GROUP BY v"
)
def venue_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "bib_references").where("venue IS NOT NULL")
    return r.select(X.venue_name("venue").alias("venue_name")).groupBy("venue_name").agg(F.count("*").alias("n"))


@query(
    """SELECT ref_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title_raw, '\\\\(?:text\\w*|emph|mathrm|mathit|mathbf)\\{([^{}]*)\\}', '\\1', 'g'), '\\\\([&%#_$])', '\\1', 'g'), '\\\\[a-zA-Z]+\\s*', '', 'g'), '[{}$]', '', 'g'), '\\s+', ' ', 'g')) AS plain
    FROM bib_references WHERE title_raw IS NOT NULL"""
)
def latex_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_references").where("title_raw IS NOT NULL").select("ref_id", X.strip_latex("title_raw").alias("plain"))


@query(f"SELECT y AS year, count(*) AS n FROM (SELECT {YEAR.format('year')} AS y FROM bib_references) GROUP BY y")
def year_parsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_references").select(X.first_year("year").alias("year")).groupBy("year").agg(F.count("*").alias("n"))


CHECKS = f"""WITH w AS (SELECT {KEY.format("title")} AS k, min_by(struct_pack(work_id := work_id, year := year, venue := venue, authors := authors), work_id) AS w FROM registry_works GROUP BY 1),
    m AS (SELECT r.*, w.w.work_id AS work_id, {YEAR.format("r.year")} AS ty, {YEAR.format("w.w.year")} AS wy, NULLIF(trim(lower(r.venue)), '') AS tv, NULLIF(trim(lower(w.w.venue)), '') AS wv,
        list_filter(list_transform(regexp_split_to_array(author, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '')[1] AS ta, w.w.authors[1] AS wa
        FROM bib_references r JOIN w ON {KEY.format("r.title")} = w.k AND w.k <> ''),
    s AS (SELECT *, lower(list_extract(str_split(trim(regexp_replace(CASE WHEN contains(ta, ',') THEN split_part(ta, ',', 1) ELSE ta END, '\\s+', ' ', 'g')), ' '), -1)) AS ts, lower(list_extract(str_split(trim(regexp_replace(CASE WHEN contains(wa, ',') THEN split_part(wa, ',', 1) ELSE wa END, '\\s+', ' ', 'g')), ' '), -1)) AS ws FROM m),
    checks AS (SELECT ref_id, work_id, 'title' AS field, 'OK' AS status FROM s
        UNION ALL SELECT ref_id, work_id, 'year', {YEAR_STATUS.format("ty", "wy")} FROM s
        UNION ALL SELECT ref_id, work_id, 'venue', CASE WHEN tv = wv OR (length(tv) > 3 AND length(wv) > 3 AND (contains(tv, wv) OR contains(wv, tv))) THEN 'OK' ELSE 'WARN' END FROM s WHERE tv IS NOT NULL AND wv IS NOT NULL
        UNION ALL SELECT ref_id, work_id, 'authors', CASE WHEN ts = ws THEN 'OK' ELSE 'FAIL' END FROM s WHERE ts IS NOT NULL AND ws IS NOT NULL)"""


def checks_of(spark: SparkSession, d: str) -> DataFrame:
    return R.field_checks(R.by_title(table(spark, d, "bib_references"), table(spark, d, "registry_works")))


@query(CHECKS + " SELECT * FROM checks")
def exact_title_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks against the registry row of the same title, which needs no search."""
    return checks_of(spark, d)


@query(CHECKS + f" SELECT ref_id, work_id, round(avg({WORTH.format('status')}), 6) AS match_score FROM checks GROUP BY ref_id, work_id")
def exact_title_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.match_scores(checks_of(spark, d))


@query(
    f"""WITH a AS (SELECT ref_id, lower({_doi("doi")}) AS d, {KEY.format("title")} AS t FROM bib_references),
    k AS (SELECT lower({_doi("doi")}) AS d, min(raw_id) AS id FROM crossref_raw GROUP BY 1 HAVING d IS NOT NULL),
    x AS (SELECT a.ref_id, 'doi' AS found_by, k.id AS found_id FROM a JOIN k USING (d)),
    w AS (SELECT {KEY.format("title")} AS t, min(work_id) AS id FROM registry_works GROUP BY 1 HAVING t <> '')
    SELECT * FROM x UNION ALL SELECT a.ref_id, 'title', w.id FROM a JOIN w USING (t) WHERE a.ref_id NOT IN (SELECT ref_id FROM x)"""
)
def id_lookup_then_search(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup(table(spark, d, "bib_references"), table(spark, d, "crossref_raw"), table(spark, d, "registry_works"))


@query(
    """SELECT bib_key, 'phantom' AS finding FROM (SELECT DISTINCT bib_key FROM scan_sentences WHERE bib_key IS NOT NULL EXCEPT SELECT cite_key FROM bib_references)
    UNION ALL SELECT cite_key, 'orphan' FROM (SELECT DISTINCT cite_key FROM bib_references WHERE cite_key IS NOT NULL EXCEPT SELECT bib_key FROM scan_sentences)"""
)
def audit_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    return R.audit(table(spark, d, "scan_sentences"), table(spark, d, "bib_references").withColumnRenamed("cite_key", "bib_key"), "bib_key")


@query(
    f"""WITH t AS (SELECT DISTINCT {KEY.format("title")} AS title FROM registry_works), w AS (SELECT title, list_distinct(str_split(title, ' ')) AS w FROM t WHERE title <> '')
    SELECT a.title AS title_a, b.title AS title_b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS likeness FROM w a JOIN w b ON a.title < b.title
    WHERE round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) >= 0.85"""
)
def fuzzy_self_join_titles(spark: SparkSession, d: str) -> DataFrame:
    return R.alike_titles(table(spark, d, "registry_works"))


@query(
    f"""WITH r AS (SELECT {KEY.format("title")} AS title_key, {YEAR.format("year")} AS y, work_id FROM registry_works),
    p AS (SELECT a.title_key, {YEAR_STATUS.format("a.y", "b.y").replace("<=2", "=1")} AS s FROM r a JOIN r b ON a.title_key = b.title_key AND a.work_id < b.work_id)
    SELECT title_key, count(*) AS pairs, round(avg({WORTH.format("s")}), 6) AS score FROM p GROUP BY title_key"""
)
def pairwise_consistency(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "registry_works").select(X.title_key("title").alias("title_key"), X.first_year("year").alias("y"))
    return R.consistency(r, "title_key", "y", R.year_status(F.col("va"), F.col("vb"), F.lit(True)))


@query(
    """SELECT c_name, s_name, round(jaro_winkler_similarity(c_name, s_name), 6) AS likeness FROM (SELECT DISTINCT c_name, c_nationkey FROM customer), supplier WHERE c_nationkey = s_nationkey AND jaro_winkler_similarity(c_name, s_name) >= 0.6"""
)
def jaro_winkler_names(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select("c_name", "c_nationkey").distinct(), table(spark, d, "supplier").select("s_name", "s_nationkey")
    # few nations and short tables make very many pairs: customers in shares, suppliers in each share, in as many tasks as a shuffle has
    shares, tasks = 16, max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = c.withColumn("share", F.pmod(F.xxhash64("c_name"), F.lit(shares)).cast("int")).repartition(tasks, "c_nationkey", "share")
    s = s.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "s_nationkey", "share")
    pairs = c.join(s.hint("shuffle_hash"), (F.col("c_nationkey") == F.col("s_nationkey")) & (c["share"] == s["share"]))
    return pairs.select("c_name", "s_name", jaro_winkler("c_name", "s_name").alias("likeness")).where("likeness >= 0.6").withColumn("likeness", F.round("likeness", 6))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return R.first_copies(table(spark, d, "documents").where("text IS NOT NULL"), F.sha2("text", 256), "doc_id")


@query(
    """SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7')) AS n FROM documents) WHERE n <= 20"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 20)


@query()
def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("item"), "p_size")
    return R.budgeted(p, [-F.col("p_size").cast("int"), F.col("item")], "p_size", 200.0, "brand")


@query(
    """SELECT sentence_id, pdf_sha256, lag(sentence_id) OVER w AS before_id, lead(sentence_id) OVER w AS after_id FROM scan_sentences WINDOW w AS (PARTITION BY pdf_sha256 ORDER BY char_start, sentence_id)"""
)
def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("pdf_sha256").orderBy("char_start", "sentence_id")
    s = table(spark, d, "scan_sentences").select("sentence_id", "pdf_sha256", "char_start")
    return s.select("sentence_id", "pdf_sha256", F.lag("sentence_id").over(w).alias("before_id"), F.lead("sentence_id").over(w).alias("after_id"))


@query(
    """SELECT sentence_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '~?\\\\cite[a-zA-Z]*\\*?(?:\\[[^\\]]*\\])*\\{[^}]*\\}', ' [CIT]', 'g'), '\\[\\d+(?:\\s*[,;–-]\\s*\\d+)*\\]', '[CIT]', 'g'), '\\s+', ' ', 'g')) AS masked FROM scan_sentences WHERE text IS NOT NULL"""
)
def citations_masked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_sentences").where("text IS NOT NULL").select("sentence_id", X.mask_citations("text").alias("masked"))


@query(
    """SELECT doc_id, CAST(i // 3 AS INTEGER) AS window_no, CAST(i + 1 AS INTEGER) AS line_start, CAST(least(i + 6, len(l)) AS INTEGER) AS line_end, md5(array_to_string(list_slice(l, i + 1, i + 6), chr(10))) AS text_md5
    FROM (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS i FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE trim(array_to_string(list_slice(l, i + 1, i + 6), ' ')) <> ''"""
)
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    at = lines.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(3))).alias("i"))
    part = F.slice("l", F.col("i") + 1, F.lit(6))
    shown = at.where(F.trim(F.array_join(part, " ")) != "")
    return shown.select("doc_id", (F.col("i") / 3).cast("int").alias("window_no"), (F.col("i") + 1).alias("line_start"), F.least(F.col("i") + 6, F.size("l")).alias("line_end"), F.md5(F.array_join(part, "\n")).alias("text_md5"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


@query("SELECT item_id, array_to_string(str_split(text, ' '), ' ') AS text FROM eval_passages WHERE text IS NOT NULL")
def deinvert_index(spark: SparkSession, d: str) -> DataFrame:
    """Texts as inverted maps {word: [places]} and back."""
    words = table(spark, d, "eval_passages").where("text IS NOT NULL").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    inverted = words.groupBy("item_id", "word").agg(F.collect_list("place").alias("places"))
    flat = inverted.select("item_id", "word", F.explode("places").alias("place"))
    return flat.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word), " ").alias("text"))


MESSAGE = """WITH b AS (SELECT raw_id, json(body) AS b FROM crossref_raw WHERE body IS NOT NULL AND json_valid(body)),
    m AS (SELECT raw_id, CASE json_type(b -> '$.message') WHEN 'VARCHAR' THEN CASE WHEN json_valid(b ->> '$.message') THEN json(b ->> '$.message') END WHEN 'OBJECT' THEN b -> '$.message' END AS m FROM b)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(raw_id, m): the message objects of valid answers as JSON text."""
    raw = table(spark, d, "crossref_raw").where(F.try_parse_json("body").isNotNull())
    m = F.get_json_object("body", "$.message")
    return raw.select("raw_id", m.alias("m")).where(F.col("m").startswith("{"))


@query(
    MESSAGE
    + """ SELECT raw_id, m ->> '$.title[0]' AS title, m ->> '$."container-title"[0]' AS venue, m ->> '$.DOI' AS doi, m ->> '$.type' AS kind, CAST(json_array_length(m, '$.author') AS INTEGER) AS authors, m ->> '$.author[0].family' AS first_family,
    TRY_CAST(m ->> '$.issued."date-parts"[0][0]' AS INTEGER) AS year FROM m WHERE m IS NOT NULL"""
)
def answer_fields(spark: SparkSession, d: str) -> DataFrame:
    g = lambda p: F.get_json_object("m", p)
    shape = "array<struct<family:string>>"
    return messages(spark, d).select(
        "raw_id", g("$.title[0]").alias("title"), g("$.container-title[0]").alias("venue"), g("$.DOI").alias("doi"), g("$.type").alias("kind"),
        F.size(F.from_json(g("$.author"), shape)).alias("authors"), g("$.author[0].family").alias("first_family"), g("$.issued.date-parts[0][0]").try_cast("int").alias("year"),
    )


@query(
    MESSAGE
    + """ SELECT raw_id, CAST(i AS INTEGER) AS place, r ->> '$.key' AS ref_key, r ->> '$.year' AS year, r ->> '$.unstructured' AS unstructured FROM (SELECT raw_id, unnest(CAST(m -> '$.reference' AS JSON[])) AS r, unnest(range(CAST(json_array_length(m, '$.reference') AS BIGINT))) AS i FROM m WHERE json_type(m -> '$.reference') = 'ARRAY')"""
)
def answer_references(spark: SparkSession, d: str) -> DataFrame:
    shape = "array<struct<key:string,year:string,unstructured:string>>"
    refs = messages(spark, d).select("raw_id", F.posexplode(F.from_json(F.get_json_object("m", "$.reference"), shape)).alias("place", "r"))
    return refs.select("raw_id", "place", F.col("r.key").alias("ref_key"), F.col("r.year").alias("year"), F.col("r.unstructured").alias("unstructured"))


@query(
    MESSAGE
    + """, u AS (SELECT raw_id, unnest(CAST(m -> '$."update-to"' AS JSON[])) AS u, unnest(range(CAST(json_array_length(m, '$."update-to"') AS BIGINT))) AS i FROM m WHERE json_type(m -> '$."update-to"') = 'ARRAY')
    SELECT raw_id, u ->> '$.DOI' AS notice_doi, u ->> '$.type' AS kind, concat_ws('-', u ->> '$.updated."date-parts"[0][0]', lpad(u ->> '$.updated."date-parts"[0][1]', 2, '0'), lpad(u ->> '$.updated."date-parts"[0][2]', 2, '0')) AS updated
    FROM u WHERE contains(lower(u ->> '$.type'), 'retract') QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY i) = 1"""
)
def retraction_notices(spark: SparkSession, d: str) -> DataFrame:
    shape = "array<struct<DOI:string,type:string,updated:struct<`date-parts`:array<array<string>>>>>"
    u = messages(spark, d).select("raw_id", F.from_json(F.get_json_object("m", "$.update-to"), shape).alias("u"))
    first = u.select("raw_id", F.get(F.filter("u", lambda x: F.lower(x["type"]).contains("retract")), F.lit(0)).alias("n")).where("n IS NOT NULL")
    part = F.get(F.col("n.updated.date-parts"), F.lit(0))
    date = F.concat_ws("-", F.get(part, F.lit(0)), *(F.lpad(F.get(part, F.lit(k)), 2, "0") for k in (1, 2)))
    return first.select("raw_id", F.col("n.DOI").alias("notice_doi"), F.col("n.type").alias("kind"), date.alias("updated"))


@query(
    f"""SELECT entry_id, {YEAR.format("raw")} AS year, NULLIF(regexp_extract(raw, '(10\\.\\d{{4,}}/[^\\s,;]+)', 1), '') AS doi, NULLIF(regexp_extract(raw, '"([^"]+)"', 1), '') AS quoted_title,
    NULLIF(regexp_extract(raw, '(?i)arxiv:\\s*(\\d{{4}}\\.\\d{{4,5}})', 1), '') AS arxiv FROM pdf_ref_entries WHERE raw IS NOT NULL"""
)
def entry_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pdf_ref_entries").where("raw IS NOT NULL")
    pick = lambda p: F.nullif(F.regexp_extract("raw", p, 1), F.lit(""))
    return e.select("entry_id", X.first_year("raw").alias("year"), pick(r"(10\.\d{4,}/[^\s,;]+)").alias("doi"), pick('"([^"]+)"').alias("quoted_title"), pick(r"(?i)arxiv:\s*(\d{4}\.\d{4,5})").alias("arxiv"))


@query(
    """SELECT a.entry_id, min(b.ref_id) AS ref_id FROM (SELECT entry_id, lower(surnames[1]) AS s, year AS y FROM pdf_ref_entries WHERE len(surnames) > 0) a
    JOIN (SELECT ref_id, lower(list_extract(str_split(trim(regexp_replace(CASE WHEN contains(f, ',') THEN split_part(f, ',', 1) ELSE f END, '\\s+', ' ', 'g')), ' '), -1)) AS s, year AS y FROM (SELECT ref_id, year, list_filter(list_transform(regexp_split_to_array(author, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '')[1] AS f FROM bib_references)) b
    ON a.s = b.s AND a.y = b.y GROUP BY a.entry_id"""
)
def author_year_markers(spark: SparkSession, d: str) -> DataFrame:
    """Scanned entries and the first typed reference with the same first surname and year."""
    a = table(spark, d, "pdf_ref_entries").where(F.size("surnames") > 0).select("entry_id", F.lower(F.element_at("surnames", 1)).alias("s"), F.col("year").alias("y"))
    r = table(spark, d, "bib_references").select("ref_id", F.lower(X.surname(F.try_element_at(X.authors("author"), F.lit(1)))).alias("s"), F.col("year").alias("y"))
    first = r.where("s IS NOT NULL AND y IS NOT NULL").groupBy("s", "y").agg(F.min("ref_id").alias("ref_id"))
    return a.join(first, ["s", "y"]).select("entry_id", "ref_id")


@query("SELECT doc_kind, source, count(*) AS n, CAST(grouping(doc_kind, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (doc_kind, source)")
def split_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("doc_kind", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(
    """SELECT ref_id, '@' || lower(entry_type) || '{' || cite_key || ',' || chr(10) || concat_ws(',' || chr(10), """
    + ", ".join(f"CASE WHEN NULLIF(trim({n}), '') IS NOT NULL THEN '  {n} = {{' || {n} || '}}' END" for n in ("title", "author", "year", "journal", "booktitle", "volume", "pages", "doi", "url"))
    + """) || chr(10) || '}' AS entry FROM bib_references"""
)
def bibtex_sink(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "bib_references")
    return files.bibtex_text(r, "ref_id").drop("cite_key")


@query("SELECT name AS registry, domain, id_type FROM (VALUES " + ", ".join(f"('{n}', '{d}', '{i}')" for n, (d, ids, _) in REGISTRIES.items() for i in ids.split() or [""]) + ") t(name, domain, id_type) WHERE id_type <> ''")
def registry_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, dom, i) for n, (dom, ids, _) in REGISTRIES.items() for i in ids.split()]
    return spark.createDataFrame(rows, "registry string, domain string, id_type string")

"""Queries of verification: searches, field checks, flags, composite scores and tiers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import verify as V
from citeloom.plans import score_queries as S
from citeloom.plans import text_queries as T
from citeloom.plans.registry import SQL, query
from citeloom.session import cut, table

TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
JAC = "(CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END)"
FIRST = "NULLIF(strip_accents(lower(list_extract(str_split(trim(regexp_replace(CASE WHEN contains({0}[1], ',') THEN split_part({0}[1], ',', 1) ELSE {0}[1] END, '\\s+', ' ', 'g')), ' '), -1))), '')"
# that function compares bytes: letters of two get a sign of one
ONE_BYTE = "translate({0}, 'øłđæœßþð', '12345678')"
WHOLE = "(CASE WHEN regexp_matches({0}, '^\\s*\\d{{1,4}}\\s*$') THEN CAST(trim({0}) AS INTEGER) END)"
GIVEN = "NULLIF(trim({0}), '')"
LIST = "list_filter(list_transform(regexp_split_to_array(author, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '')"
PLAUSIBLE = "({0} IS NULL OR {1} IS NULL OR {0} = {1} OR (coalesce(abs({2} - {3}) < 2, true) AND {4} >= 0.85))"
VENUE = "(SELECT CASE " + " ".join(f"WHEN starts_with(l, '{a}') THEN '{b}'" for a, b in X.VENUES) + " ELSE l END FROM (SELECT trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')) AS l))"

SEARCH = f"""WITH r0 AS (SELECT ref_id, bib_file, title, {LIST} AS authors, year, coalesce({GIVEN.format("venue")}, {GIVEN.format("booktitle")}, {GIVEN.format("journal")}) AS venue, doi, arxiv_id FROM bib_references),
    r AS (SELECT *, {FIRST.format("authors")} AS fa, {WHOLE.format("year")} AS ya, {TOK.format("title")} AS ta FROM r0),
    w AS (SELECT *, {FIRST.format("authors")} AS fb, {WHOLE.format("year")} AS yb, {TOK.format("title")} AS tb FROM registry_works),
    met AS (SELECT r.ref_id, w.registry, w.work_id, {JAC.format("ta", "tb")} AS likeness FROM r JOIN w ON len(ta) > 0 AND len(tb) > 0 AND {JAC.format("ta", "tb")} >= 0.6 AND {PLAUSIBLE.format("fa", "fb", "ya", "yb", JAC.format("ta", "tb"))}),
    best AS (SELECT ref_id, registry, work_id, round(likeness, 6) AS likeness FROM met QUALIFY row_number() OVER (PARTITION BY ref_id, registry ORDER BY likeness DESC, work_id) = 1)"""
STATUS3 = "CASE WHEN {0} >= 0.85 THEN 'OK' WHEN {0} >= 0.70 THEN 'WARN' ELSE 'FAIL' END"
MATCHES = (
    SEARCH
    + ", "
    + T.MESSAGE.removeprefix("WITH ")
    + f""", notices AS (SELECT raw_id FROM ({SQL["retraction_notices"]})),
    known AS (SELECT lower({T._doi("c.doi")}) AS d, arg_min(struct_pack(m := m.m, raw_id := m.raw_id), m.raw_id) AS x FROM m JOIN crossref_raw c USING (raw_id) WHERE m.m IS NOT NULL AND {T._doi("c.doi")} IS NOT NULL GROUP BY 1),
    hits AS (SELECT ref_id, best.registry, false AS by_id, w.title AS etitle, w.authors AS eauthors, w.year AS eyear, w.venue AS evenue, false AS retracted FROM best JOIN w USING (work_id)
        UNION ALL SELECT r.ref_id, 'crossref', true, k.x.m ->> '$.title[0]', CASE WHEN json_type(k.x.m -> '$.author') = 'ARRAY' THEN list_filter(list_transform(CAST(k.x.m -> '$.author' AS JSON[]), lambda a: trim(concat_ws(' ', a ->> '$.given', a ->> '$.family'))), lambda a: a <> '') END,
            CAST(TRY_CAST(k.x.m ->> '$.issued."date-parts"[0][0]' AS INTEGER) AS VARCHAR), k.x.m ->> '$."container-title"[0]', k.x.raw_id IN (SELECT raw_id FROM notices) FROM r JOIN known k ON lower({T._doi("r.doi")}) = k.d),
    h0 AS (SELECT hits.*, r.title, r.authors, r.year, r.venue, fa, ya, {FIRST.format("eauthors")} AS fb, {WHOLE.format("eyear")} AS yb, CASE WHEN {GIVEN.format("title")} IS NOT NULL AND {GIVEN.format("etitle")} IS NOT NULL THEN {JAC.format("ta", TOK.format("etitle"))} END AS title_score FROM hits JOIN r USING (ref_id)),
    h1 AS (SELECT *, CASE WHEN fa = fb THEN 1.0 ELSE coalesce(jaro_winkler_similarity({ONE_BYTE.format('fa')}, {ONE_BYTE.format('fb')}), 0) END AS author_score, {VENUE.format("venue")} AS va, {VENUE.format("evenue")} AS vb FROM h0 WHERE {PLAUSIBLE.format("fa", "fb", "ya", "yb", "coalesce(title_score, 0)")}),
    h2 AS (SELECT *, CASE WHEN title_score IS NOT NULL THEN {STATUS3.format("title_score")} END AS title_status,
        CASE WHEN coalesce(len(authors), 0) < 1 OR coalesce(len(eauthors), 0) < 1 THEN NULL WHEN fa IS NULL OR fb IS NULL THEN 'WARN' WHEN author_score >= 0.9 AND (len(list_filter(authors, lambda x: contains(lower(x), 'others') OR contains(lower(x), 'et al'))) > 0 OR abs(len(authors) - len(eauthors)) <= 2) THEN 'OK' WHEN author_score >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS authors_status,
        CASE WHEN {GIVEN.format("year")} IS NULL OR {GIVEN.format("eyear")} IS NULL THEN NULL WHEN abs(ya - yb) IS NULL OR abs(ya - yb) = 1 THEN 'WARN' WHEN ya = yb THEN 'OK' WHEN abs(ya - yb) = 2 AND NOT by_id THEN 'WARN' ELSE 'FAIL' END AS year_status,
        CASE WHEN {GIVEN.format("venue")} IS NULL OR {GIVEN.format("evenue")} IS NULL THEN NULL WHEN ((contains(va, 'arxiv') OR contains(va, 'corr')) AND (contains(vb, 'arxiv') OR contains(vb, 'corr'))) OR (length(va) > 3 AND length(vb) > 3 AND (contains(va, vb) OR contains(vb, va))) OR {JAC.format(TOK.format("va"), TOK.format("vb"))} >= 0.5 THEN 'OK' ELSE 'WARN' END AS venue_status,
        {JAC.format(TOK.format("venue"), TOK.format("evenue"))} AS vs FROM h1),
    sm AS (SELECT ref_id, registry, by_id, retracted, title_status, authors_status, year_status, venue_status, round(title_score, 6) AS title_score, CASE WHEN authors_status IS NOT NULL THEN round(author_score, 6) END AS author_score,
        CASE WHEN year_status IS NOT NULL THEN round(coalesce(greatest(0.0, 1 - 0.5 * abs(ya - yb)), 0.5), 6) END AS year_score, CASE WHEN venue_status = 'OK' THEN round(greatest(vs, 0.8), 6) WHEN venue_status IS NOT NULL THEN round(vs, 6) END AS venue_score,
        round(coalesce(list_avg(list_filter(list_transform([title_status, authors_status, year_status, venue_status], lambda s: {T.WORTH.format("s")}), lambda x: x IS NOT NULL)), 0), 6) AS match_score,
        coalesce(title_status = 'OK', false) AND coalesce(authors_status IN ('OK', 'WARN'), false) AS confirmed, fa = fb AS same_first FROM h2)"""
)


def references(spark: SparkSession, d: str) -> DataFrame:
    """(ref_id, bib_file, title, authors, year, venue, doi, arxiv_id) of the typed references."""
    venue = F.coalesce(*(X.present(c) for c in ("venue", "booktitle", "journal")))
    return table(spark, d, "bib_references").select("ref_id", "bib_file", "title", X.authors("author").alias("authors"), "year", venue.alias("venue"), "doi", "arxiv_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(d, etitle, eauthors, eyear, evenue, retracted): the first valid answer of each DOI."""
    m = T.messages(spark, d).join(table(spark, d, "crossref_raw").select("raw_id", F.lower(X.clean_doi("doi")).alias("d")), "raw_id").where("d IS NOT NULL")
    first = m.groupBy("d").agg(F.min(F.struct("raw_id", "m")).alias("x")).select("d", "x.*")
    g = lambda p: F.get_json_object("m", p)
    people = F.when(g("$.author").startswith("["), F.from_json(g("$.author"), "array<struct<given:string,family:string>>"))
    names = F.filter(F.transform(people, lambda a: F.trim(F.concat_ws(" ", a.given, a.family))), lambda a: a != "")
    notices = T.retraction_notices(spark, d).select("raw_id", F.lit(True).alias("noticed"))
    return first.join(notices, "raw_id", "left").select("d", g("$.title[0]").alias("etitle"), names.alias("eauthors"), g("$.issued.date-parts[0][0]").try_cast("int").cast("string").alias("eyear"), g("$.container-title[0]").alias("evenue"), F.coalesce("noticed", F.lit(False)).alias("retracted"))


def matches_of(spark: SparkSession, d: str) -> DataFrame:
    """The source matches as a table between steps: most queries read them several times."""
    refs, works = references(spark, d), table(spark, d, "registry_works")
    found = V.search(refs, works).join(works.select("work_id", F.col("title").alias("etitle"), F.col("authors").alias("eauthors"), F.col("year").alias("eyear"), F.col("venue").alias("evenue")), "work_id")
    searched = found.select("ref_id", "registry", F.lit(False).alias("by_id"), "etitle", "eauthors", "eyear", "evenue", F.lit(False).alias("retracted"))
    known = refs.select("ref_id", F.lower(X.clean_doi("doi")).alias("d")).join(answers(spark, d), "d").select("ref_id", F.lit("crossref").alias("registry"), F.lit(True).alias("by_id"), "etitle", "eauthors", "eyear", "evenue", "retracted")
    return cut(V.source_matches(refs.select("ref_id", "title", "authors", "year", "venue"), searched.unionByName(known)))


@query(SEARCH + " SELECT * FROM best")
def registry_search(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each registry for each title, by a search with a guard of authors and years."""
    return V.search(references(spark, d), table(spark, d, "registry_works"))


@query(MATCHES + " SELECT * EXCLUDE (same_first) FROM sm")
def source_matches(spark: SparkSession, d: str) -> DataFrame:
    return matches_of(spark, d).drop("same_first")


@query(
    MATCHES
    + """, c AS (SELECT ref_id, 'year' AS reason FROM h2 WHERE by_id AND abs(ya - yb) BETWEEN 2 AND 60 UNION SELECT ref_id, 'authors' FROM h2 WHERE by_id AND authors_status = 'FAIL' UNION SELECT ref_id, 'title' FROM h2 WHERE by_id AND title_status = 'FAIL')
    SELECT ref_id, reason FROM c"""
)
def natural_chimeras(spark: SparkSession, d: str) -> DataFrame:
    """References whose identifier belongs to another work, by the field that contradicts it; years up to 60 apart count."""
    m = matches_of(spark, d).where("by_id")
    bad = lambda k, c: F.when(F.coalesce(c, F.lit(False)), F.lit(k))
    # a year two apart or more is a failed one for a work found by its identifier; its score tells the distance no further
    years = references(spark, d).select("ref_id", V.whole_year("year").alias("ya"), F.lower(X.clean_doi("doi")).alias("d")).join(answers(spark, d).select("d", V.whole_year("eyear").alias("yb")), "d").select("ref_id", F.abs(F.col("ya") - F.col("yb")).between(2, 60).alias("far"))
    reasons = F.explode(F.array_compact(F.array(bad("year", F.col("far")), bad("authors", F.col("authors_status") == "FAIL"), bad("title", F.col("title_status") == "FAIL")))).alias("reason")
    return m.join(years, "ref_id").select("ref_id", reasons).distinct()


LONG = MATCHES + """, long AS (SELECT ref_id, registry, by_id, unnest(['title', 'authors', 'year', 'venue']) AS field, unnest([title_status, authors_status, year_status, venue_status]) AS status FROM sm)"""


@query(LONG + " SELECT * FROM long WHERE status IS NOT NULL")
def field_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every field check of every source in long form."""
    c = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"{k}_status").alias("status")) for k in ("title", "authors", "year", "venue")))).alias("c")
    return matches_of(spark, d).select("ref_id", "registry", "by_id", c).select("ref_id", "registry", "by_id", "c.*").where("status IS NOT NULL")


@query(MATCHES + " SELECT ref_id, registry, by_id, match_score FROM sm")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    return matches_of(spark, d).select("ref_id", "registry", "by_id", "match_score")


ORDER = "CASE registry " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(V.PRIORITY)) + f" ELSE {len(V.PRIORITY)} END"
CLEAN = "confirmed AND NOT (coalesce(title_status = 'FAIL', false) OR coalesce(authors_status = 'FAIL', false) OR coalesce(year_status = 'FAIL', false) OR coalesce(venue_status = 'FAIL', false))"


@query(MATCHES + f" SELECT ref_id, registry, match_score FROM (SELECT *, coalesce(sum(CASE WHEN {CLEAN} THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY {ORDER}, registry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM sm) WHERE seen < 2")
def search_until_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return V.stop_early(matches_of(spark, d)).select("ref_id", "registry", "match_score")


COMPOSITE = (
    MATCHES
    + """, g AS (SELECT ref_id, max(struct_pack(match_score := match_score, by_id := by_id)) AS best, coalesce(max(title_score), 0) AS title, coalesce(max(author_score), 0) AS author, coalesce(max(venue_score), 0) AS venue FROM sm GROUP BY ref_id),
    e AS (SELECT *, CASE WHEN best.by_id THEN 1.0 WHEN best.match_score >= 85 THEN 0.9 WHEN best.match_score >= 60 THEN 0.6 ELSE 0.3 END::DOUBLE AS existence FROM g),
    comp AS (SELECT ref_id, existence, title, author, venue, round(0.35 * existence + 0.25 * title + 0.15 * author + 0.10 * venue + 0.075, 6) AS overall FROM e)"""
)


@query(COMPOSITE + " SELECT *, CASE WHEN overall >= 0.85 THEN 'supported' WHEN overall >= 0.6 THEN 'possible' ELSE 'suspicious' END AS label FROM comp")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return V.composite(matches_of(spark, d))


OVERALL = (
    MATCHES
    + """, long AS (SELECT ref_id, by_id, confirmed, retracted, unnest(['title', 'authors', 'year', 'venue']) AS f, unnest([title_status, authors_status, year_status, venue_status]) AS s FROM sm),
    o AS (SELECT ref_id, bool_or(confirmed) AS sure, bool_or(retracted) AS retracted, bool_or(confirmed AND coalesce(s = 'FAIL', false) AND NOT (f = 'year' AND NOT by_id)) AS hard, bool_or(confirmed AND (coalesce(s = 'WARN', false) OR (coalesce(s = 'FAIL', false) AND f = 'year' AND NOT by_id))) AS soft, bool_or(coalesce(s = 'FAIL', false)) AS fail, bool_or(coalesce(s = 'WARN', false)) AS warn FROM long GROUP BY ref_id),
    n AS (SELECT ref_id, count(*) AS sources, count_if(confirmed)::BIGINT AS confirmed FROM sm GROUP BY ref_id),
    ov AS (SELECT r.ref_id, coalesce(sources, 0) AS sources, coalesce(confirmed, 0) AS confirmed, CASE WHEN sure IS NULL OR retracted THEN 'FAIL' WHEN sure THEN CASE WHEN hard THEN 'FAIL' WHEN soft THEN 'WARN' ELSE 'OK' END WHEN fail THEN 'FAIL' WHEN warn THEN 'WARN' ELSE 'OK' END AS status FROM r LEFT JOIN o USING (ref_id) LEFT JOIN n USING (ref_id))"""
)


@query(OVERALL + " SELECT * FROM ov")
def verification_status(spark: SparkSession, d: str) -> DataFrame:
    return V.overall(references(spark, d), matches_of(spark, d))


@query(OVERALL + " SELECT bib_file, count(*) AS refs, count_if(status = 'OK')::BIGINT AS ok, count_if(status = 'WARN')::BIGINT AS warn, count_if(status = 'FAIL')::BIGINT AS fail, round(100.0 * count_if(sources > 0) / count(*), 6) AS coverage FROM ov JOIN r USING (ref_id) GROUP BY bib_file")
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Status counts and coverage of every bibliography."""
    refs = references(spark, d)
    s = V.overall(refs, matches_of(spark, d)).join(refs.select("ref_id", "bib_file"), "ref_id")
    n = lambda x: F.count_if(F.col("status") == x).alias(x.lower())
    return s.groupBy("bib_file").agg(F.count("*").alias("refs"), n("OK"), n("WARN"), n("FAIL"), F.round(100.0 * F.count_if(F.col("sources") > 0) / F.count("*"), 6).alias("coverage"))


FLAGS = (
    MATCHES
    + f""", per AS (SELECT ref_id, count(*) AS n, bool_or(by_id) AS by_id, bool_or(registry = 'arxiv') AS arxiv, bool_or(coalesce(same_first, false) AND coalesce(title_score < 0.5, false)) AS chimera FROM sm GROUP BY ref_id),
    lists AS (SELECT bib_file, count(*) AS refs, avg(CASE WHEN length(title) - length(replace(title, ':', '')) = 1 THEN 1.0 ELSE 0.0 END) AS share FROM r GROUP BY bib_file),
    f0 AS (SELECT r.*, coalesce(n > 0, false) AS hit, coalesce(by_id, false) AS id_found, coalesce(arxiv, false) AS arxiv, coalesce(chimera, false) AS chimera, refs, share FROM r LEFT JOIN per USING (ref_id) LEFT JOIN lists ON r.bib_file = lists.bib_file),
    flags AS (SELECT ref_id, 'phantom_doi' AS flag, CASE WHEN hit THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM f0 WHERE {T._doi("doi")} IS NOT NULL AND NOT id_found
        UNION ALL SELECT ref_id, 'phantom_arxiv', CASE WHEN hit THEN 0.8 ELSE 0.9 END FROM f0 WHERE regexp_matches(arxiv_id, '^\\d{{4}}\\.\\d{{4,5}}') AND NOT arxiv
        UNION ALL SELECT ref_id, 'no_registry_match', CASE WHEN hit THEN 0.4 ELSE 0.7 END FROM f0 WHERE length(title) >= 10 AND NOT id_found
        UNION ALL SELECT ref_id, 'author_title_chimera', 0.7 FROM f0 WHERE chimera
        UNION ALL SELECT ref_id, 'temporal_impossibility', CASE WHEN ya > {S.LAST_YEAR} + 1 THEN 0.95 ELSE 0.6 END FROM f0 WHERE ya > {S.LAST_YEAR} + 1 OR (ya < 1990 AND regexp_matches(lower(venue), 'neurips|nips|iclr|arxiv'))
        UNION ALL SELECT ref_id, 'format_anomaly', 0.3 FROM f0 WHERE refs >= 5 AND share > 0.7 AND contains(title, ':')),
    points(flag, p) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in V.FLAG_POINTS.items())}),
    scored AS (SELECT ref_id, count(*) AS flags, round(least(100, sum(p * confidence)), 6) AS score FROM flags JOIN points USING (flag) GROUP BY ref_id)"""
)


def flags_of(spark: SparkSession, d: str) -> DataFrame:
    return V.hallucination_flags(references(spark, d), matches_of(spark, d), S.LAST_YEAR)


@query(FLAGS + " SELECT ref_id, flag, confidence FROM flags")
def reference_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags_of(spark, d)


@query(FLAGS + " SELECT *, score >= 50 AS likely FROM scored")
def hallucination_score(spark: SparkSession, d: str) -> DataFrame:
    return V.hallucination_scores(flags_of(spark, d))


@query(FLAGS.replace(MATCHES, COMPOSITE) + " SELECT r.ref_id FROM r LEFT JOIN comp USING (ref_id) LEFT JOIN scored USING (ref_id) WHERE overall BETWEEN 0.55 AND 0.85 OR score > 30 OR ref_id IN (SELECT ref_id FROM sm GROUP BY ref_id HAVING NOT bool_or(confirmed))")
def escalated(spark: SparkSession, d: str) -> DataFrame:
    """References that a closer look is worth: a middling composite score, suspicion, or sources of which none confirms."""
    m = matches_of(spark, d)
    middling = V.composite(m).where("overall BETWEEN 0.55 AND 0.85").select("ref_id")
    doubted = V.hallucination_scores(V.hallucination_flags(references(spark, d), m, S.LAST_YEAR)).where("score > 30").select("ref_id")
    loose = m.groupBy("ref_id").agg(F.bool_or("confirmed").alias("c")).where("NOT c").select("ref_id")
    return middling.unionByName(doubted).unionByName(loose).distinct()


L0 = (
    FLAGS.replace(MATCHES, OVERALL)
    + """, bm AS (SELECT ref_id, max(match_score) AS ms, bool_or(by_id) AS by_id, bool_or(retracted) AS retracted, bool_or(by_id AND (coalesce(authors_status = 'FAIL', false) OR coalesce(year_status = 'FAIL', false))) AS chimera FROM sm GROUP BY ref_id),
    l0 AS (SELECT r.ref_id, bm.ref_id IS NOT NULL AS found, ms, coalesce(by_id, false) AS by_id, coalesce(retracted, false) AS retracted, coalesce(chimera, false) AS chimera, coalesce(score, 0) AS score, status FROM r LEFT JOIN bm USING (ref_id) LEFT JOIN scored USING (ref_id) JOIN ov USING (ref_id)),
    sig AS (SELECT ref_id, 'reference_not_found' AS signal_name, NOT found AS fired, CASE WHEN found THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM l0 UNION ALL SELECT ref_id, 'phantom_doi', score >= 50, least(score / 100, 1) FROM l0
        UNION ALL SELECT ref_id, 'metadata_mismatch', ms < 65 OR status = 'FAIL', CASE WHEN ms < 65 OR status = 'FAIL' THEN 0.8 ELSE 0.9 END FROM l0 WHERE found UNION ALL SELECT ref_id, 'chimera_detected', chimera, CASE WHEN chimera THEN 0.9 ELSE 0.95 END FROM l0 WHERE by_id
        UNION ALL SELECT ref_id, 'no_id_match', found AND NOT by_id, CASE WHEN found AND NOT by_id THEN 0.85 ELSE 0.9 END FROM l0 UNION ALL SELECT ref_id, 'retracted_citation', retracted, 1.0 FROM l0)"""
)


def verification_signals_of(spark: SparkSession, d: str) -> DataFrame:
    """(ref_id, signal_name, fired, confidence, score, status): what verification observes of each reference."""
    refs, m = references(spark, d), matches_of(spark, d)
    fail = lambda k: F.coalesce(F.col(f"{k}_status") == "FAIL", F.lit(False))
    best = m.groupBy("ref_id").agg(F.max("match_score").alias("ms"), F.bool_or("by_id").alias("by_id"), F.bool_or("retracted").alias("retracted"), F.bool_or(F.col("by_id") & (fail("authors") | fail("year"))).alias("chimera"))
    scores = V.hallucination_scores(V.hallucination_flags(refs, m, S.LAST_YEAR)).select("ref_id", "score")
    base = V.overall(refs, m).select("ref_id", "status").join(best, "ref_id", "left").join(scores, "ref_id", "left")
    no = F.lit(False)
    found, by_id, score = F.col("ms").isNotNull(), F.coalesce("by_id", no), F.coalesce("score", F.lit(0.0))
    wrong, chimera, loose = (F.col("ms") < 65) | (F.col("status") == "FAIL"), F.coalesce("chimera", no), found & ~by_id
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    rows = {
        "reference_not_found": (F.lit(True), ~found, pick(found, 1.0, 0.9)), "phantom_doi": (F.lit(True), score >= 50, F.least(score / 100, F.lit(1.0))), "metadata_mismatch": (found, wrong, pick(wrong, 0.8, 0.9)),
        "chimera_detected": (by_id, chimera, pick(chimera, 0.9, 0.95)), "no_id_match": (F.lit(True), loose, pick(loose, 0.85, 0.9)), "retracted_citation": (F.lit(True), F.coalesce("retracted", no), F.lit(1.0)),
    }
    each = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(k).alias("signal_name"), f.alias("fired"), c.alias("confidence"))) for k, (w, f, c) in rows.items())))
    return base.select("ref_id", F.explode(each).alias("s"), score.alias("score"), "status").select("ref_id", "s.*", "score", "status")


@query(L0 + " SELECT ref_id, signal_name, fired, round(confidence, 6) AS confidence FROM sig")
def verification_signals(spark: SparkSession, d: str) -> DataFrame:
    return verification_signals_of(spark, d).select("ref_id", "signal_name", "fired", F.round("confidence", 6).alias("confidence"))


KILL = (
    L0
    + ", "
    + S.DEFS_SQL
    + f""", nb AS (SELECT ref_id, 1 / (1 + exp(-({S.ODDS} + sum(confidence * CASE WHEN fired THEN ln(lr_pos) ELSE ln(lr_neg) END)))) AS p FROM sig JOIN defs USING (signal_name) GROUP BY ref_id),
    tiered AS (SELECT ref_id, round(p, 6) AS p, {S.TIER.format("p")} AS tier, score FROM nb JOIN l0 USING (ref_id))"""
)


@query(KILL + " SELECT ref_id, CASE WHEN score >= 50 AND tier IN ('low', 'elevated') THEN 'high' ELSE tier END AS tier, round(CASE WHEN score >= 50 AND tier IN ('low', 'elevated') THEN greatest(p, score / 100) ELSE p END, 6) AS probability, CASE WHEN score >= 50 THEN 'HIGH' ELSE tier END AS legacy_tier FROM tiered")
def risk_with_override(spark: SparkSession, d: str) -> DataFrame:
    """Fused risk, lifted to high where a reference is likely invented; and the tier as first published."""
    from citeloom.operators import fusion

    s = verification_signals_of(spark, d)
    score = s.groupBy("ref_id").agg(F.max("score").alias("score"))
    r = fusion.naive_bayes(s.select("ref_id", F.lit(1).alias("seq"), "signal_name", "fired", "confidence"), fusion.definitions(spark)).join(score, "ref_id")
    tier, p = V.kill_shot(F.col("tier"), F.col("posterior"), F.col("score"))
    return r.select("ref_id", tier.alias("tier"), F.round(p, 6).alias("probability"), V.kill_shot(F.col("tier"), F.col("posterior"), F.col("score"), legacy=True)[0].alias("legacy_tier"))


@query(OVERALL + ", c AS (SELECT ref_id, bool_or(label = 'CONTRADICTED') AS con FROM nli_results GROUP BY ref_id) SELECT ref_id, CASE WHEN status = 'FAIL' THEN 'high' WHEN status = 'WARN' THEN 'elevated' WHEN con THEN 'high' ELSE 'low' END AS tier FROM ov LEFT JOIN c USING (ref_id)")
def fallback_tiers(spark: SparkSession, d: str) -> DataFrame:
    con = table(spark, d, "nli_results").where("label = 'CONTRADICTED'").select("ref_id", F.lit("CONTRADICTED").alias("label")).distinct()
    return V.overall(references(spark, d), matches_of(spark, d)).join(con, "ref_id", "left").select("ref_id", V.fallback_tier(F.col("status"), F.col("label")).alias("tier"))


@query("SELECT result_id, CASE label WHEN 'CONTRADICTED' THEN 'critical' WHEN 'UNSUPPORTED' THEN CASE WHEN confidence > 0.7 THEN 'high' ELSE 'medium' END WHEN 'PARTIALLY_SUPPORTED' THEN 'medium' WHEN 'UNVERIFIABLE' THEN 'unknown' ELSE 'low' END AS risk FROM nli_results")
def claim_risks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nli_results").select("result_id", V.claim_risk(F.col("label"), F.col("confidence")).alias("risk"))


PAIRS_SQL = MATCHES + """, p AS (SELECT a.ref_id, a.etitle AS ta, b.etitle AS tb, a.eauthors AS aa, b.eauthors AS ab, a.eyear AS ya, b.eyear AS yb, a.evenue AS va, b.evenue AS vb FROM hits a JOIN hits b ON a.ref_id = b.ref_id AND (a.registry, a.by_id) < (b.registry, b.by_id))"""


@query(
    PAIRS_SQL
    + f""", x AS (SELECT ref_id, 'title' AS field, {STATUS3.format(JAC.format(TOK.format("ta"), TOK.format("tb")))} AS status FROM p WHERE {GIVEN.format("ta")} IS NOT NULL AND {GIVEN.format("tb")} IS NOT NULL
        UNION ALL SELECT ref_id, 'authors', CASE WHEN {FIRST.format("aa")} IS NULL OR {FIRST.format("ab")} IS NULL OR {FIRST.format("aa")} <> {FIRST.format("ab")} THEN 'FAIL' WHEN abs(len(aa) - len(ab)) <= 2 THEN 'OK' ELSE 'WARN' END FROM p WHERE len(aa) > 0 AND len(ab) > 0
        UNION ALL SELECT ref_id, 'year', CASE WHEN {WHOLE.format("ya")} = {WHOLE.format("yb")} THEN 'OK' WHEN abs({WHOLE.format("ya")} - {WHOLE.format("yb")}) > 1 THEN 'FAIL' ELSE 'WARN' END FROM p WHERE {GIVEN.format("ya")} IS NOT NULL AND {GIVEN.format("yb")} IS NOT NULL)
    SELECT ref_id, field, count(*) AS pairs, round(avg({T.WORTH.format("status")}), 6) AS score FROM x GROUP BY ref_id, field"""
)
def source_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How far the sources of a reference agree with one another on title, authors and year."""
    refs, works = references(spark, d), table(spark, d, "registry_works")
    found = V.search(refs, works).join(works.select("work_id", F.col("title").alias("etitle"), F.col("authors").alias("eauthors"), F.col("year").alias("eyear")), "work_id").select("ref_id", "registry", F.lit(False).alias("by_id"), "etitle", "eauthors", "eyear")
    known = refs.select("ref_id", F.lower(X.clean_doi("doi")).alias("d")).join(answers(spark, d), "d").select("ref_id", F.lit("crossref").alias("registry"), F.lit(True).alias("by_id"), "etitle", "eauthors", "eyear")
    every = found.unionByName(known).withColumn("first", V.first_surname("eauthors")).withColumn("words", X.tokens("etitle"))
    # a reference has one row for each registry, so its pairs are few
    a = every.select("ref_id", *(F.col(c).alias(f"{c}_a") for c in every.columns[1:]))
    b = every.select("ref_id", *(F.col(c).alias(f"{c}_b") for c in every.columns[1:]))
    p = a.join(b, "ref_id").where("struct(registry_a, by_id_a) < struct(registry_b, by_id_b)")
    title = F.when(X.present("etitle_a").isNotNull() & X.present("etitle_b").isNotNull(), V.title_status(X.jaccard("words_a", "words_b")))
    same = F.coalesce(F.col("first_a") == F.col("first_b"), F.lit(False))
    authors = F.when((F.size("eauthors_a") > 0) & (F.size("eauthors_b") > 0), F.when(~same, "FAIL").when(F.abs(F.size("eauthors_a") - F.size("eauthors_b")) <= 2, "OK").otherwise("WARN"))
    away = F.abs(V.whole_year("eyear_a") - V.whole_year("eyear_b"))
    year = F.when(X.present("eyear_a").isNotNull() & X.present("eyear_b").isNotNull(), F.when(away == 0, "OK").when(away > 1, "FAIL").otherwise("WARN"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), s.alias("status")) for k, s in (("title", title), ("authors", authors), ("year", year))))).alias("c")
    return p.select("ref_id", rows).where("c.status IS NOT NULL").groupBy("ref_id", "c.field").agg(F.count("*").alias("pairs"), F.round(F.avg(V.worth(F.col("c.status"))), 6).alias("score"))

"""Queries of graph anomalies on a citation graph of typed works, each beside its SQL.

A bibliography stands for the work of its first entry, which cites the works of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import anomaly as A
from citeloom.operators import graph as G
from citeloom.plans import text_queries as T
from citeloom.plans.registry import query
from citeloom.plans.verify_queries import LIST, WHOLE
from citeloom.session import table

SUR = "list_extract(str_split(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), ' '), -1)"
GRAPH = f"""WITH t AS (SELECT ref_id, bib_file, {T.KEY.format("title")} AS id, {WHOLE.format("year")} AS year, {LIST} AS names FROM bib_references WHERE {T.KEY.format("title")} <> ''),
    first AS (SELECT bib_file, arg_min(id, ref_id) AS src, min(ref_id) AS ref_id FROM t GROUP BY bib_file),
    edges AS (SELECT src, t.id AS dst FROM t JOIN first f ON t.bib_file = f.bib_file AND t.ref_id <> f.ref_id),
    nodes AS (SELECT id, arg_min(coalesce(year, 0), ref_id) AS year, list_distinct(list_transform(arg_min(coalesce(names, []), ref_id), lambda x: {SUR.format("x")})) AS authors FROM t GROUP BY id)"""


def citation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): works by their title, each bibliography's first work citing the others."""
    t = table(spark, d, "bib_references").select("ref_id", "bib_file", X.title_key("title").alias("id"), F.when(F.col("year").rlike(r"^\s*\d{1,4}\s*$"), F.trim("year").cast("int")).alias("year"), X.authors("author").alias("names")).where("id <> ''")
    first = t.groupBy("bib_file").agg(F.min_by("id", "ref_id").alias("src"), F.min("ref_id").alias("first_id"))
    edges = t.join(first, "bib_file").where("ref_id <> first_id").select("src", F.col("id").alias("dst"))
    # authors as typed: the last word of a name, whatever its order
    last = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.element_at(F.split(F.lower(X.squeeze(x)), " "), -1))
    nodes = t.groupBy("id").agg(F.min_by(F.struct(F.coalesce("year", F.lit(0)).alias("year"), F.array_distinct(last).alias("authors")), "ref_id").alias("x")).select("id", "x.year", "x.authors")
    return nodes, edges


DENSITY = """, refs AS (SELECT src, count(*) AS refs FROM edges GROUP BY src HAVING count(*) >= 5), members AS (SELECT DISTINCT src, dst FROM edges SEMI JOIN refs USING (src)),
    ins AS (SELECT m.src, count(*) AS k FROM members m JOIN edges e ON e.src = m.dst JOIN members t ON t.src = m.src AND t.dst = e.dst GROUP BY m.src), dens AS (SELECT refs.src, round(coalesce(k, 0) / (refs * (refs - 1)), 6) AS density FROM refs LEFT JOIN ins USING (src))"""
ORPHANS = DENSITY + """, orphans AS (SELECT 'orphan_cluster' AS anomaly, src AS node, CASE WHEN density < 0.01 THEN 'high' ELSE 'medium' END AS severity, round(1 - density / 0.05, 6) AS score FROM dens WHERE density < 0.05)"""
LATER = """, later AS (SELECT 'temporal_anomaly' AS anomaly, src AS node, CASE WHEN b.year - a.year > 2 THEN 'critical' WHEN b.year - a.year > 1 THEN 'high' ELSE 'medium' END AS severity, round(least((b.year - a.year) / 5, 1), 6) AS score FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.year > 0 AND b.year > a.year)"""
SELF = """, rates AS (SELECT src, count(*) AS refs, avg(CASE WHEN list_has_any(a.authors, b.authors) THEN 1.0 ELSE 0.0 END) AS rate FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE len(a.authors) > 0 GROUP BY src),
    own AS (SELECT 'excessive_self_citation' AS anomaly, src AS node, CASE WHEN rate > 0.5 THEN 'high' ELSE 'medium' END AS severity, round(least((rate - 0.3) / 0.7, 1), 6) AS score FROM rates WHERE refs >= 5 AND rate > 0.3)"""
PAIRS = """, named AS (SELECT unnest(a.authors) AS s, b.authors AS ts FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst), cross_ AS (SELECT s, unnest(ts) AS t FROM named), dir AS (SELECT s, t, count(*) AS n FROM cross_ WHERE s <> t GROUP BY s, t),
    pairs AS (SELECT x.s AS a, x.t AS b, x.n AS ab, y.n AS ba, least(x.n, y.n) / greatest(x.n, y.n) AS r FROM dir x JOIN dir y ON x.s = y.t AND x.t = y.s AND x.s < x.t WHERE x.n >= 3 AND y.n >= 3),
    recip AS (SELECT a, b, ab, ba, round(r, 6) AS ratio, CASE WHEN ab + ba > 10 THEN 'high' ELSE 'medium' END AS severity, round(least(r * (ab + ba) / 20, 1), 6) AS score FROM pairs WHERE r > 0.5)"""
BURST = """, tot AS (SELECT dst, count(*) AS total, count(DISTINCT src) AS sources FROM edges GROUP BY dst HAVING count(*) >= 5), yr AS (SELECT dst, a.year AS year, count(*) AS n FROM edges JOIN nodes a ON a.id = src WHERE a.year > 0 GROUP BY 1, 2),
    step AS (SELECT dst, year, n, lag(n) OVER (PARTITION BY dst ORDER BY year) AS p FROM yr), spike AS (SELECT dst, arg_min(n / p, year) AS spike FROM step WHERE p > 0 AND n > 3 * p GROUP BY dst),
    topk AS (SELECT dst, sum(k) AS top FROM (SELECT dst, src, count(*) AS k FROM edges GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, src) <= 3) GROUP BY dst),
    bs AS (SELECT dst, spike, greatest(coalesce(least((spike - 3) / 6, 1), 0), CASE WHEN top / total > 0.5 AND sources >= 3 THEN top / total ELSE 0 END) AS sc FROM tot JOIN topk USING (dst) LEFT JOIN spike USING (dst) WHERE spike IS NOT NULL OR (top / total > 0.5 AND sources >= 3)),
    burst AS (SELECT 'citation_burst' AS anomaly, dst AS node, CASE WHEN sc > 0.7 THEN 'high' ELSE 'medium' END AS severity, round(sc, 6) AS score FROM bs)"""


@query(GRAPH + ORPHANS + " SELECT * FROM orphans")
def anomaly_orphans(spark: SparkSession, d: str) -> DataFrame:
    return A.orphan_clusters(citation_graph(spark, d)[1])


@query(GRAPH + LATER + " SELECT * FROM later")
def anomaly_temporal(spark: SparkSession, d: str) -> DataFrame:
    return A.temporal(*citation_graph(spark, d))


@query(GRAPH + SELF + " SELECT * FROM own")
def anomaly_self_citation(spark: SparkSession, d: str) -> DataFrame:
    return A.self_citation(*citation_graph(spark, d))


@query(GRAPH + PAIRS + " SELECT * FROM recip")
def anomaly_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    return A.reciprocal_authors(*citation_graph(spark, d))


@query(GRAPH + BURST + " SELECT * FROM burst")
def anomaly_bursts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = citation_graph(spark, d)
    years = edges.join(nodes.select(F.col("id").alias("src"), "year"), "src").where("year > 0").groupBy("dst", "year").agg(F.count("*").alias("n"))
    return A.bursts(edges, years)


@query()
def anomaly_rings(spark: SparkSession, d: str) -> DataFrame:
    """Groups of works that cite one another; grown greedily, so a test compares it with a plain loop."""
    return A.ring_rows(citation_graph(spark, d)[1])


@query()
def anomaly_all(spark: SparkSession, d: str) -> DataFrame:
    return A.all_anomalies(*citation_graph(spark, d))


@query()
def anomaly_health(spark: SparkSession, d: str) -> DataFrame:
    return A.health(A.all_anomalies(*citation_graph(spark, d)))


@query()
def anomaly_signals(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_signals(A.all_anomalies(*citation_graph(spark, d)))


@query(GRAPH + " SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS outgoing, (SELECT count(*) FROM edges WHERE dst = id) AS incoming FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def citation_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(citation_graph(spark, d)[1])

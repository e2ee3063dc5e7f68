"""Queries on graphs and on the call log, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import graph as G
from citeloom.plans.registry import query
from citeloom.session import table
from citeloom.streaming import breaker

# Two graphs: papers and what they cite, and customer nations and the supplier nations they buy from.
CITED = "c AS (SELECT paper_doi AS src, lower(trim(doi)) AS dst FROM sneaked_matches WHERE paper_doi IS NOT NULL AND trim(doi) <> '')"
TRADE = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def cited(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sneaked_matches").where("paper_doi IS NOT NULL AND trim(doi) <> ''")
    return m.select(F.col("paper_doi").alias("src"), F.lower(F.trim("doi")).alias("dst"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


def strong(spark: SparkSession, d: str, times: float = 1.0) -> DataFrame:
    """Pairs of nations that trade more than so many times the average pair."""
    n = trade(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.avg("n").alias("mean")), F.col("n") > times * F.col("mean")).select("src", "dst")  # the mean is one row


STRONG = f"WITH {TRADE}, n AS (SELECT src, dst, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT src, dst FROM n WHERE n > (SELECT avg(n) FROM n))"


@query(f"WITH {CITED} SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT src AS id, 1 AS o, 0 AS i FROM c UNION ALL SELECT dst, 0, 1 FROM c) GROUP BY id")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(cited(spark, d))


@query(
    f"""WITH RECURSIVE {CITED}, b AS (SELECT src AS a, dst AS z FROM c UNION SELECT dst, src FROM c), r(id, low) USING KEY (id) AS (SELECT a, least(a, min(z)) FROM b GROUP BY a
    UNION SELECT * FROM (SELECT b.a, min(r.low) AS low FROM r JOIN b ON b.z = r.id GROUP BY b.a) n WHERE low < (SELECT low FROM recurring.r x WHERE x.id = n.a)) SELECT id, low AS component FROM r"""
)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(cited(spark, d))


@query(f"WITH {TRADE}, n AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL) SELECT x.src AS a, x.dst AS b, x.n AS ab, y.n AS ba FROM n x JOIN n y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def graph_mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.mutual(trade(spark, d))


@query(STRONG + " SELECT x.src AS a, x.dst AS b, y.dst AS c FROM s x JOIN s y ON x.dst = y.src JOIN s z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND y.dst <> x.dst")
def graph_rings_triangles(spark: SparkSession, d: str) -> DataFrame:
    return G.triangles(strong(spark, d))


@query(
    f"""WITH {TRADE}, n AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL), m AS (SELECT x.src AS a, x.dst AS b, x.n AS ab, y.n AS ba FROM n x JOIN n y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst)
    SELECT a, b, ab, ba, round(least(ab, ba)::DOUBLE / greatest(ab, ba), 6) AS ratio, round(least(least(ab, ba)::DOUBLE / greatest(ab, ba) * (ab + ba) / 20, 1), 6) AS score FROM m WHERE ab >= 3 AND ba >= 3 AND least(ab, ba)::DOUBLE / greatest(ab, ba) > 0.5"""
)
def graph_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    return G.reciprocal(trade(spark, d))


@query(
    """WITH e AS (SELECT o_orderkey AS src, l_linenumber AS line, year(o_orderdate)::INTEGER AS src_year, year(l_shipdate)::INTEGER AS dst_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT *, dst_year - src_year AS gap, CASE WHEN dst_year - src_year > 2 THEN 'critical' WHEN dst_year - src_year > 1 THEN 'high' ELSE 'medium' END AS severity, round(least((dst_year - src_year) / 5.0, 1), 6) AS score FROM e WHERE dst_year > src_year"""
)
def graph_temporal_anomaly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("src_year"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("dst_year"))
    return G.temporal(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("src"), "line", "src_year", "dst_year"))


@query(
    """WITH f AS (SELECT o_orderpriority, CAST(substr(regexp_replace(printf('%.6f', o_totalprice), '[^1-9]*', '', 'g'), 1, 1) AS INTEGER) AS digit FROM orders WHERE o_totalprice > 0), o AS (SELECT o_orderpriority, digit, count(*) AS o FROM f GROUP BY ALL),
    t AS (SELECT o_orderpriority, sum(o) AS n FROM o GROUP BY 1 HAVING sum(o) >= 20), e AS (SELECT o_orderpriority, n, unnest(range(1, 10)) AS digit FROM t),
    x AS (SELECT e.o_orderpriority, max(n)::BIGINT AS n, sum(pow(coalesce(o, 0) - n * log10(1 + 1.0 / digit), 2) / (n * log10(1 + 1.0 / digit))) AS x FROM e LEFT JOIN o USING (o_orderpriority, digit) GROUP BY 1)
    SELECT o_orderpriority, n, round(x, 4) AS chi2, CASE WHEN x > 20.09 THEN 'high' WHEN x > 15.507 THEN 'medium' ELSE 'none' END AS violated FROM x"""
)
def graph_benford(spark: SparkSession, d: str) -> DataFrame:
    return G.benford(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")


YEARLY = "WITH y AS (SELECT l_partkey AS part, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(YEARLY + ", s AS (SELECT *, lag(n) OVER (PARTITION BY part ORDER BY year) AS before FROM y) SELECT part, year, before, n FROM s WHERE n > 3 * before QUALIFY row_number() OVER (PARTITION BY part ORDER BY year) = 1")
def graph_burst_yoy(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    n = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("part"), "year").agg(F.count("*").alias("n"))
    return G.bursts(n, "part", "year", "n")


@query(
    """WITH n AS (SELECT l_partkey AS dst, l_suppkey AS src, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT dst, n FROM n QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) <= 3),
    t AS (SELECT dst, count(*) AS sources, sum(n)::BIGINT AS total FROM n GROUP BY dst), x AS (SELECT dst, sources, total, (SELECT sum(n) FROM b WHERE b.dst = t.dst)::DOUBLE / total AS x FROM t WHERE sources >= 3) SELECT dst, sources, total, round(x, 6) AS top_share FROM x WHERE x > 0.2"""
)
def graph_top3_concentration(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return G.concentration(e, 0.2)


@query(
    STRONG
    + """, r AS (SELECT src, count(*) AS refs FROM s GROUP BY src HAVING count(*) >= 5), i AS (SELECT a.src, count(*) AS inside FROM s a JOIN s b ON a.src = b.src JOIN s x ON x.src = a.dst AND x.dst = b.dst GROUP BY a.src)
    SELECT src, refs, coalesce(inside, 0) AS inside, round(coalesce(inside, 0)::DOUBLE / (refs * (refs - 1)), 6) AS density FROM r LEFT JOIN i USING (src)"""
)
def graph_orphan_density(spark: SparkSession, d: str) -> DataFrame:
    return G.densities(strong(spark, d))


@query(STRONG + " SELECT x.src, x.dst AS via, y.dst FROM s x JOIN s y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM s z WHERE z.src = x.src AND z.dst = y.dst)")
def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return G.two_hops(strong(spark, d))


@query(
    STRONG
    + """, n AS (SELECT count(*) AS nodes FROM (SELECT src FROM s UNION SELECT dst FROM s)), e AS (SELECT count(*) AS edges FROM s), m AS (SELECT count(*) AS both FROM s x JOIN s y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst)
    SELECT nodes, edges, round(edges::DOUBLE / (nodes * (nodes - 1)), 6) AS density, round(both::DOUBLE / edges, 6) AS mutual_share, round(edges::DOUBLE / nodes, 6) AS mean_degree, round(100 - 40 * least(both::DOUBLE / edges, 1), 4) AS score FROM n, e, m""".replace(", n AS (SELECT count(*) AS nodes", ", nn AS (SELECT count(*) AS nodes").replace("FROM n, e, m", "FROM nn, ee, m").replace(", e AS (SELECT count(*) AS edges", ", ee AS (SELECT count(*) AS edges").replace(" AS both", ' AS "both"').replace("both::", '"both"::')
)
def graph_health(spark: SparkSession, d: str) -> DataFrame:
    return G.health(strong(spark, d))


@query(
    """WITH x AS (SELECT l_orderkey, c_nationkey = s_nationkey AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    g AS (SELECT l_orderkey, count(*) AS refs, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS s FROM x GROUP BY 1) SELECT l_orderkey, refs, round(s, 6) AS share, CASE WHEN s > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE refs >= 5 AND s > 0.3"""
)
def graph_self_citation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("refs"), F.avg((F.col("c_nationkey") == F.col("s_nationkey")).cast("double")).alias("s"))
    return x.where("refs >= 5 AND s > 0.3").select("l_orderkey", "refs", F.round("s", 6).alias("share"), F.when(F.col("s") > 0.5, "high").otherwise("medium").alias("severity"))


@query(
    "WITH f AS (SELECT event_type, event_id, ts, count(*) FILTER (event_type = 'error') OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS failures FROM events) SELECT event_id, failures FROM f WHERE event_type = 'error' AND failures >= 5"
)
def breaker_window(spark: SparkSession, d: str) -> DataFrame:
    return breaker.tripping(table(spark, d, "events"), seconds=3600, failures=5)


@query()
def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    return breaker.replay(spark, d)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def seen_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

"""Registered queries of the core operators, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import nested
from citeloom.plans import anomaly_queries, claim_queries, detail_queries, graph_queries, more_queries, registry_queries, score_queries, text_queries, verify_queries  # noqa: F401
from citeloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from citeloom.session import table


@query(
    """
    WITH ok AS (SELECT raw_id, json(body) AS b FROM crossref_raw WHERE body IS NOT NULL AND json_valid(body)),
    m AS (SELECT raw_id, CASE json_type(b -> '$.message') WHEN 'VARCHAR' THEN CASE WHEN json_valid(b ->> '$.message') THEN json(b ->> '$.message') END ELSE b -> '$.message' END AS m FROM ok),
    funders AS (SELECT raw_id, CASE json_type(m -> '$.funder') WHEN 'ARRAY' THEN CAST(m -> '$.funder' AS JSON[]) WHEN 'OBJECT' THEN [m -> '$.funder'] END AS f FROM m),
    funder AS (SELECT raw_id, unnest(f) AS f, unnest(range(len(f))) AS i FROM funders),
    awards AS (SELECT raw_id, i, CASE WHEN json_type(f -> '$.award') = 'ARRAY' THEN CAST(f -> '$.award' AS JSON[]) WHEN json_type(f -> '$.award') IS NOT NULL THEN [f -> '$.award'] END AS a FROM funder),
    award AS (SELECT raw_id, i, unnest(a) AS v, unnest(range(len(a))) AS j FROM awards),
    licences AS (SELECT raw_id, CASE json_type(m -> '$.license') WHEN 'ARRAY' THEN CAST(m -> '$.license' AS JSON[]) WHEN 'OBJECT' THEN [m -> '$.license'] END AS f FROM m),
    licence AS (SELECT raw_id, unnest(f) -> '$.URL' AS v, unnest(range(len(f))) AS i FROM licences),
    isbns AS (SELECT raw_id, CASE json_type(m -> '$."isbn-type"') WHEN 'ARRAY' THEN CAST(m -> '$."isbn-type"' AS JSON[]) WHEN 'OBJECT' THEN [m -> '$."isbn-type"'] END AS f FROM m),
    isbn AS (SELECT raw_id, unnest(f) -> '$.value' AS v, unnest(range(len(f))) AS i FROM isbns),
    u AS (SELECT raw_id, 'funder_award' AS child, i, j, v FROM award UNION ALL SELECT raw_id, 'license_url', i, 0, v FROM licence UNION ALL SELECT raw_id, 'isbn_value', i, 0, v FROM isbn)
    SELECT raw_id, child, CAST(i AS INTEGER) AS parent_no, CAST(j AS INTEGER) AS child_no, v ->> '$' AS value FROM u WHERE v IS NOT NULL AND json_type(v) <> 'NULL' AND (v ->> '$') <> ''
    """
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.answer_children(table(spark, d, "crossref_raw"))


@query()
def p3_triples(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(table(spark, d, "crossref_raw"), "raw_id", "body", unwrap=("message",))


@query()
def p3_repeated_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return nested.repeated_ancestors(p3_triples(spark, d))


@query()
def p3_funders(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(p3_triples(spark, d), "message.funder", {"name": "name", "DOI": "doi"}, {"message": "message_no", "message.funder": "funder_no"})

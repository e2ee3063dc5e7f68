"""Queries of the operators for training text, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import entity_match, layout_copies, leakage, lookalike, markup, names, packing, sentences
from citeloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "bib_references"), table(spark, d, "pdf_ref_entries"), table(spark, d, "sneaked_matches"))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(names.typed_names(table(spark, d, "bib_references"), table(spark, d, "pdf_ref_entries"), table(spark, d, "sneaked_matches")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found(table(spark, d, "crossref_raw"), table(spark, d, "bib_references"), table(spark, d, "scan_sentences"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(table(spark, d, "crossref_raw"), table(spark, d, "bib_references"), table(spark, d, "scan_sentences"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return layout_copies.found(table(spark, d, "bib_references"), table(spark, d, "pdf_ref_entries"))


def p4_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per record that has copies, with their number."""
    p = p4_found(spark, d)
    return p.groupBy("src", "keep_id").agg((F.count("*") + 1).alias("copies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.found(table(spark, d, "bib_references"), table(spark, d, "registry_works"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match(table(spark, d, "bib_references"), table(spark, d, "registry_works"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "scan_sentences"), table(spark, d, "nli_results"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_entities, p2_found, p2_clean, p4_found, p4_copy_counts, p5_found, p5_matches, p6_found, p7_found, p7_containers, p8_found, p9_found, p9_canonical)
    return {f.__name__: f for f in named}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def skeleton_sql(column: str) -> str:
    """The look-alike mapping in SQL; composed accents instead of a collation."""
    plain = f"translate(regexp_replace({column}, {_quoted(lookalike.UNSEEN.replace(chr(92) * 2, chr(92)))}, '', 'g'), {_quoted(''.join(lookalike.ONE_TO_ONE))}, {_quoted(''.join(lookalike.ONE_TO_ONE.values()))})"
    for joined, letters in lookalike.JOINED.items():
        plain = f"replace({plain}, {_quoted(joined)}, {_quoted(letters)})"
    return f"nfc_normalize({plain})"


def words_sql(column: str) -> str:
    return f"regexp_extract_all(lower({skeleton_sql(f'nfc_normalize({column})')}), '[\\p{{L}}\\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": """
            SELECT s.spec_id, d.doc_id FROM documents d JOIN pack_specs s ON octet_length(encode(d.text)) + 1 > s.capacity""",
        "p8_found": f"""
            WITH i AS (SELECT item_id, {words_sql("text")} AS w FROM eval_passages), d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
            a AS (SELECT item_id, unnest(list_transform(range(1, len(w) - {leakage.STRETCH - 2}), lambda k: array_to_string(list_slice(w, k, k + {leakage.STRETCH - 1}), ' '))) AS g FROM i WHERE len(w) >= {leakage.STRETCH}),
            b AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {leakage.STRETCH - 2}), lambda k: array_to_string(list_slice(w, k, k + {leakage.STRETCH - 1}), ' '))) AS g FROM d WHERE len(w) >= {leakage.STRETCH})
            SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
        "p9_found": f"""
            WITH s AS (SELECT doc_id, text, {skeleton_sql("text")} AS k FROM documents WHERE text IS NOT NULL)
            SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p9_canonical": f"""
            WITH s AS (SELECT doc_id, text, {skeleton_sql("text")} AS k FROM documents)
            SELECT doc_id, CASE WHEN text IS NOT NULL THEN min(text) OVER (PARTITION BY k) END AS canonical FROM s""",
    }

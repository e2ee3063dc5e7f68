"""Readers of office and TeX files, bulk manifests and labelled corpora, and writers of result files.

Binary files come in with `binaryFile` and are taken apart by an Arrow function, one file a
row; everything read from JSON or XML keeps a stated schema.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X

FORMAT_VERSION = 1


def sniff(content: bytes) -> str | None:
    """'pdf', 'tar', 'gz', 'zip' or 'xml' by the first bytes; a gz whose checksum fails is None."""
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:2] == b"\x1f\x8b":
        try:
            inner = gzip.decompress(content)
        except (OSError, EOFError):
            return None
        return "tar" if tarfile.is_tarfile(io.BytesIO(inner)) else "gz"
    if content[:4] == b"PK\x03\x04":
        return "zip"
    if content[:5] == b"<?xml":
        return "xml"
    return "tar" if len(content) > 262 and content[257:262] == b"ustar" else None


def docx_paragraphs(content: bytes) -> list[str]:
    """The text of each paragraph of a Word file; none where it is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    name = lambda e: e.tag.rpartition("}")[2]
    return ["".join(t.text or "" for t in p.iter() if name(t) == "t") for p in root.iter() if name(p) == "p"]


def read_docx(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """(path, place, raw): the entries of the reference lists of Word files.

    Paragraphs behind the last heading of a list, or else of the last two fifths; numbers in
    front go, and captions, headings and short lines are none. At most `most` of a file, as
    a list longer than that is none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for at, content in zip(files.path, files.content):
                lines = [x.strip() for x in docx_paragraphs(bytes(content))]
                heads = [k for k, x in enumerate(lines) if re.fullmatch(r"(?i)(?:references|bibliography|literature cited)\W*", x)]
                tail = lines[heads[-1] + 1 :] if heads else lines[len(lines) * 3 // 5 :]
                rows += [(at, k, x) for k, x in enumerate(tail[:most]) if x]
            yield pd.DataFrame(rows, columns=["path", "place", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = files.mapInPandas(run, "path string, place int, text string")
    bare = F.trim(F.regexp_replace("text", r"^\s*(?:\[\d+\]|\d+[.)])\s*", ""))
    kept = lines.where(~F.col("text").rlike(r"(?i)^(?:figure|table|appendix|chapter)\b"))
    return kept.select("path", "place", bare.alias("raw")).where(F.length("raw") >= 20)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sha256) of all files below path, by content; the name plays no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            yield pd.DataFrame({"path": files.path, "kind": [sniff(bytes(c)) for c in files.content], "sha256": files.sha256})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return files.mapInPandas(run, "path string, kind string, sha256 string")


def unique_files(files: DataFrame) -> DataFrame:
    """The first path of each content (path, sha256)."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"))


def included(texts: DataFrame) -> DataFrame:
    """(src, dst): which TeX file inputs or includes which, of texts (path, text); names without an ending mean .tex."""
    bare = F.regexp_replace("text", r"(?m)(?<!\\)%.*$", "")
    name = F.explode(F.regexp_extract_all(bare, F.lit(r"\\(?:input|include)\s*\{([^}]+)\}"), F.lit(1))).alias("name")
    to = F.when(F.col("name").endswith(".tex"), F.trim("name")).otherwise(F.concat(F.trim("name"), F.lit(".tex")))
    return texts.select(F.col("path").alias("src"), name).select("src", to.alias("dst"))


def tex_abstract(c: Column | str) -> Column:
    """The text of the abstract environment; null where there is none."""
    return F.nullif(X.strip_latex(F.regexp_extract(c, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)), F.lit(""))


def bbl_arxiv_ids(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cite_key, arxiv): the arXiv ids of the items of compiled bibliographies."""
    items = F.explode(F.slice(F.split(text_col, r"\\bibitem"), 2, 1 << 20)).alias("item")
    key = F.regexp_extract("item", r"^\s*(?:\[(?:[^\[\]]|\[[^\]]*\])*\])?\s*\{([^}]+)\}", 1)
    number = F.nullif(F.regexp_extract("item", r"(?i)arxiv[:./ ]*(?:abs/)?(\d{4}\.\d{4,5})", 1), F.lit(""))
    return texts.select(F.col(id_col), items).select(id_col, key.alias("cite_key"), number.alias("arxiv")).where("cite_key <> '' AND arxiv IS NOT NULL")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, yymm, size, items, md5) of a bulk manifest, to be taken newest first."""
    m = spark.read.format("xml").option("rowTag", "file").schema("filename STRING, yymm STRING, size LONG, num_items LONG, content_md5sum STRING").load(path)
    return m.select("filename", "yymm", "size", F.col("num_items").alias("items"), F.col("content_md5sum").alias("md5"))


CLAIMS = "id LONG, claim STRING, evidence MAP<STRING, ARRAY<STRUCT<sentences: ARRAY<INT>, label: STRING>>>, cited_doc_ids ARRAY<LONG>"
ABSTRACTS = "doc_id LONG, title STRING, abstract ARRAY<STRING>"


def read_claim_pairs(spark: SparkSession, claims: str, corpus: str) -> DataFrame:
    """(claim_id, doc_id, claim, premise, label): claims with the gold sentences of a cited abstract.

    The label of a document is that of its last rationale, as published; claims without
    evidence give the whole abstract of each cited document as NOT_ENOUGH_INFO.
    """
    c = spark.read.schema(CLAIMS).json(claims)
    docs = spark.read.schema(ABSTRACTS).json(corpus).select("doc_id", "abstract")
    gold = c.select(F.col("id").alias("claim_id"), "claim", F.explode("evidence").alias("doc", "why")).select("claim_id", "claim", F.col("doc").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten("why.sentences"))).alias("at"), F.element_at("why", -1).label.alias("label"))
    none = c.where(F.coalesce(F.size("evidence"), F.lit(0)) < 1).select(F.col("id").alias("claim_id"), "claim", F.explode("cited_doc_ids").alias("doc_id"), F.lit(None).cast("array<int>").alias("at"), F.lit("NOT_ENOUGH_INFO").alias("label"))
    lines = F.when(F.col("at").isNull(), F.col("abstract")).otherwise(F.array_compact(F.transform("at", lambda k: F.get("abstract", k))))
    label = F.when(F.col("label") == "SUPPORT", "SUPPORTED").when(F.col("label") == "CONTRADICT", "CONTRADICTED").otherwise(F.col("label"))
    return gold.unionByName(none).join(docs, "doc_id").select("claim_id", "doc_id", "claim", F.array_join(lines, " ").alias("premise"), label.alias("label"))


# What the labels of two corpora mean here.
INTENTS = {"background": "mentioning", "method": "supporting", "result": "supporting"}
VERDICTS = {"SUPPORTS": "SUPPORTED", "REFUTES": "CONTRADICTED", "NOT ENOUGH INFO": "NOT_ENOUGH_INFO"}


def _mapped(c: str, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(c)]


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, intent) of a corpus of citing sentences; unknown labels are left out."""
    r = spark.read.schema("id STRING, unique_id STRING, string STRING, label STRING").json(path)
    return r.select(F.coalesce("unique_id", "id").alias("id"), F.col("string").alias("text"), _mapped("label", INTENTS).alias("intent")).where("intent IS NOT NULL")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(id, claim, label) of a corpus of checked claims; unknown labels are left out."""
    r = spark.read.schema("id LONG, claim STRING, label STRING").json(path)
    return r.select("id", "claim", _mapped("label", VERDICTS).alias("label")).where("label IS NOT NULL")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines below path."""
    df.write.mode("append" if append else "errorifexists").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Rows as JSON lines that name the version of their format."""
    df.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_results() wrote; rows of another version are an error."""
    r = spark.read.schema(f"{schema}, format_version INT").json(path)
    known = F.assert_true(F.coalesce(F.col("format_version") == FORMAT_VERSION, F.lit(False)), F.lit("unknown format_version"))
    return r.where(known.isNull()).drop("format_version")


def merged_phrases(*tables: dict[str, str]) -> dict[str, str]:
    """Phrase tables as one; of equal phrases the later table's holds, and phrases that stand for themselves go."""
    return {k: v for k, v in {k: v for t in tables for k, v in t.items()}.items() if k != v}


def worklist(records: DataFrame) -> DataFrame:
    """(bucket, place, line): records (record_id, status, opinion, quote_found, text) as a work list, by what is left to do.

    Rejected opinions come first, then those without a quote, open ones, doubtful, and last
    what holds.
    """
    bucket = (
        F.when(F.col("opinion").isNotNull() & ~F.coalesce("quote_found", F.lit(False)), 0).when(F.col("opinion") == "contradicted", 1).when(F.col("opinion") == "unsupported", 2)
        .when(F.col("opinion").isNull() & (F.col("status") == "found"), 3).when(F.col("opinion").isNull(), 4).otherwise(5)
    )
    line = F.concat(F.lit("- `"), "record_id", F.lit("` "), F.coalesce("opinion", F.lit("open")), F.lit(": "), X.clip_words("text", 40))
    return records.select(bucket.alias("bucket"), F.col("record_id").alias("place"), line.alias("line"))

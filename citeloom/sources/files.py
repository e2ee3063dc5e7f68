"""Readers and writers: BibTeX, TEI and OAI XML, JSON lines, TeX, plain reference lists, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as X

BIB_FIELDS = ("title", "author", "year", "journal", "booktitle", "volume", "pages", "doi", "url", "eprint", "note")


def split_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of the entries of a BibTeX text, by matching braces.

    Values may be braced, quoted or bare, joined by #; a text cut inside an entry loses
    that entry only. @comment, @string and @preamble are no entries.
    """
    out, at = [], 0
    head = re.compile(r"@\s*(\w+)\s*[{(]\s*([^,\s{}]*)\s*,?", re.S)
    while m := head.search(text, at):
        kind, key, i, depth = m[1].lower(), m[2], m.end(), 1
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0) if text[i - 1] != "\\" else 0
            i += 1
        at = i
        if depth or kind in ("comment", "string", "preamble"):
            if depth:
                at = m.end()
            continue
        out.append((kind, key, fields_of(text[m.end() : i - 1])))
    return out


def fields_of(body: str) -> dict[str, str]:
    """Fields of one entry's body, names in lower case; of a repeated field the first."""
    found: dict[str, str] = {}
    name, i, n = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*"), 0, len(body)
    while m := name.match(body, i):
        i, parts = m.end(), []
        while i < n:
            if body[i] in '{"':
                close, depth, k = body[i], 0, i
                while k < n:
                    c = body[k]
                    if c == "{":
                        depth += 1
                    elif c == "}":
                        depth -= 1
                    if k > i and ((close == '"' and c == '"' and depth == 0) or (close == "{" and depth == 0)):
                        break
                    k += 1
                parts.append(body[i + 1 : k])
                i = k + 1
            else:
                k = re.compile(r"[^,#\s]*").match(body, i).end()
                parts.append(body[i:k])
                i = k
            if more := re.compile(r"\s*#\s*").match(body, i):
                i = more.end()
            else:
                break
        found.setdefault(m[1].lower(), re.sub(r"\s+", " ", "".join(parts)).strip())
        i = max(i, m.end())
    return found


ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "entry_type", "cite_key", *BIB_FIELDS)])


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of .bib files, with missing fields null; each file is read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [(p, kind, key, *(f.get(n) for n in BIB_FIELDS)) for p, t in zip(files.path, files.value) for kind, key, f in split_entries(t or "")]
            yield pd.DataFrame(rows, columns=ENTRY.names, dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    e = files.mapInPandas(run, ENTRY)
    venue = F.coalesce(X.present("booktitle"), X.present("journal"))
    return e.withColumn("title_raw", F.col("title")).withColumn("title", X.strip_latex("title")).withColumn("venue", venue).withColumn("arxiv_id", X.arxiv_id(F.concat_ws(" ", "eprint", "journal", "url", "note")))


def bibtex_text(refs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, cite_key, entry): references as BibTeX entries, without empty fields."""
    field = lambda n: F.when(X.present(n).isNotNull(), F.concat(F.lit(f"  {n} = {{"), F.col(n), F.lit("}")))
    names = [n for n in ("title", "author", "year", "journal", "booktitle", "volume", "pages", "doi", "url") if n in refs.columns]
    body = F.concat_ws(",\n", *(field(n) for n in names))
    return refs.select(*keep, "cite_key", F.concat(F.lit("@"), F.lower("entry_type"), F.lit("{"), "cite_key", F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """References of TEI files: title, first surname, year, DOI, journal; nested parts stay native."""
    schema = """analytic STRUCT<title STRUCT<_VALUE STRING>, author ARRAY<STRUCT<persName STRUCT<forename STRING, surname STRING>>>, idno ARRAY<STRUCT<_VALUE STRING, _type STRING>>>,
        monogr STRUCT<title STRUCT<_VALUE STRING>, imprint STRUCT<date STRUCT<_when STRING>>>"""
    b = spark.read.format("xml").option("rowTag", "biblStruct").schema(schema).load(path)
    name = lambda a: F.concat_ws(" ", a.persName.forename, a.persName.surname)
    doi = F.get(F.filter("analytic.idno", lambda x: F.lower(x["_type"]) == "doi"), F.lit(0))
    return b.select(
        F.coalesce("analytic.title._VALUE", "monogr.title._VALUE").alias("title"), F.array_join(F.transform("analytic.author", name), " and ").alias("author"),
        F.substring("monogr.imprint.date._when", 1, 4).alias("year"), X.clean_doi(doi["_VALUE"]).alias("doi"), F.when(F.col("analytic.title._VALUE").isNotNull(), F.col("monogr.title._VALUE")).alias("venue"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; lines that are none are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def reference_section(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, raw): the entries after the last heading of a reference list, by [n] or blank lines."""
    tail = F.regexp_extract(text_col, r"(?is)^.*\n\s*(?:references|bibliography|literature cited)\s*\n(.*)$", 1)
    numbered = tail.rlike(r"(?m)^\s*\[\d+\]")
    parts = F.when(numbered, F.split(F.concat(F.lit("\n"), tail), r"\n\s*\[\d+\]\s*")).otherwise(F.split(tail, r"\n\s*\n"))
    kept = F.filter(F.transform(parts, X.squeeze), lambda x: F.length(x) >= 20)
    return texts.select(F.col(id_col), F.posexplode(kept).alias("place", "raw"))


def tex_citations(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sent_no, sentence, cite_key): sentences of TeX texts with the keys they cite.

    Comments are taken out first; a sentence with several keys gives a row for each.
    """
    bare = F.regexp_replace(text_col, r"(?m)(?<!\\)%.*$", "")
    s = texts.select(F.col(id_col), F.posexplode(X.sentences(bare)).alias("sent_no", "sentence"))
    keys = F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1)), lambda k: F.split(k, r"\s*,\s*")))
    return s.select(id_col, "sent_no", "sentence", F.explode(F.array_distinct(F.transform(keys, lambda x: F.trim(x)))).alias("cite_key"))


def report(checks: DataFrame) -> DataFrame:
    """(severity, line): a Markdown report of checks (ref_id, field, status) in order, the worst first."""
    order = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)
    line = F.format_string("- **%s** reference %d: %s", F.col("status"), F.col("ref_id"), F.col("field"))
    return checks.select(order.alias("severity"), "ref_id", "field", line.alias("line")).orderBy("severity", "ref_id", "field").select("severity", "line")


def read_oai(spark: SparkSession, path: str) -> DataFrame:
    """Records of OAI-PMH answers in Dublin Core: identifier, title, creators, year, description.

    Deleted records and those without a title are left out; descriptions keep 2000 signs.
    """
    dc = "STRUCT<title ARRAY<STRING>, creator ARRAY<STRING>, date ARRAY<STRING>, description ARRAY<STRING>, identifier ARRAY<STRING>>"
    schema = f"header STRUCT<_status STRING, identifier STRING, datestamp STRING>, metadata STRUCT<dc {dc}>"
    r = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(schema).load(path)
    d = "metadata.dc."
    kept = r.where("coalesce(header._status, '') <> 'deleted'").select(
        F.col("header.identifier").alias("identifier"), F.get(f"{d}title", F.lit(0)).alias("title"), F.coalesce(f"{d}creator", F.array().cast("array<string>")).alias("authors"), X.first_year(F.get(f"{d}date", F.lit(0))).alias("year"),
        F.substring(F.get(f"{d}description", F.lit(0)), 1, 2000).alias("description"), F.get(F.filter(F.transform(f"{d}identifier", X.clean_doi), lambda x: x.isNotNull()), F.lit(0)).alias("doi"),
    )
    return kept.where(X.present("title").isNotNull())


def harvest(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream of newly landed JSON-lines files; the checkpoint of the query remembers the place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)

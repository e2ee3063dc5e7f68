"""Queries of registry answers: works rendered as each registry would answer, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.plans.registry import query
from citeloom.session import table
from citeloom.sources.answers import READINGS, Reading, parse, render
from citeloom.sources.registry import REGISTRIES

JSON = [n for n, r in READINGS.items() if not r.xml]
ACADEMIC = [n for n in JSON if REGISTRIES[n][0] == "academic"]
OTHER = [n for n in JSON if n not in ACADEMIC]
XML = [n for n, r in READINGS.items() if r.xml]


def _sql(name: str, r: Reading) -> str:
    names = "list_filter(list_transform(authors, lambda x: trim(x)), lambda x: x <> '')"
    people = "NULL" if r.authors is None else f"array_to_string(list_slice({names}, 1, 1), ' | ')" if r.authors[1] == "one" and not r.xml else f"array_to_string({names}, ' | ')"
    year = "NULLIF(regexp_extract(year, '((?:1[89]|20)\\d\\d|2100)', 1), '')" if r.year else "NULL"
    venue = f"'{r.venue[0][1:]}'" if r.venue and r.venue[0].startswith("=") else "NULLIF(trim(venue), '')" if r.venue else "NULL"
    # XML has line feeds only
    title = "replace(replace(trim(title), chr(13) || chr(10), chr(10)), chr(13), chr(10))" if r.xml else "trim(title)"
    return f"SELECT work_id, '{name}' AS registry, {title} AS title, {people} AS authors, {year} AS year, {venue} AS venue, ice_id AS id FROM registry_works WHERE trim(title) <> ''"


def works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registry_works").select(F.col("work_id").alias("rec_id"), "title", "authors", "year", "venue", F.col("ice_id").alias("id"))


def read_back(answers: DataFrame, name: str) -> DataFrame:
    kind = next(iter(READINGS[name].ids))
    return parse(answers, name).select(F.col("rec_id").alias("work_id"), "registry", "title", F.nullif(F.array_join("authors", " | "), F.lit("")).alias("authors"), "year", "venue", F.col("ids")[kind].alias("id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(" UNION ALL ".join(_sql(n, READINGS[n]) for n in ACADEMIC))
def registry_answers_academic(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return _union([read_back(render(w, n), n) for n in ACADEMIC])


@query(" UNION ALL ".join(_sql(n, READINGS[n]) for n in OTHER))
def registry_answers_other(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return _union([read_back(render(w, n), n) for n in OTHER])


def tagged(path: str, _: str) -> tuple[str, str]:
    """The opening and closing tags of a path of elements and one predicate each."""
    import re

    steps = re.findall(r"([A-Za-z-]+)(?:\[@(\w+)='([^']+)'\])?", path.replace("text()", ""))
    return "".join(f'<{n} {a}="{v}">' if a else f"<{n}>" for n, a, v in steps), "".join(f"</{n}>" for n, _, _ in reversed(steps))


def xml_answers(w: DataFrame, name: str) -> DataFrame:
    """(rec_id, body): works as the registry's XML, every value below its own path."""
    r = READINGS[name]
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    root = r.title[0].split("/")[1] if not r.title[0].startswith("//") else "answer"
    inner = lambda p: p.removeprefix(f"/{root}") if not p.startswith("//") else p
    parts = [(r.title[0], F.col("title"))] + [(p[0], F.col(c)) for p, c in ((r.year, "year"), (r.venue, "venue")) if p and not p[0].startswith("=")] + [(p, F.col("id")) for p in r.ids.values()]
    texts = [F.concat(F.lit(a), safe(c), F.lit(b)) for p, c in parts for a, b in [tagged(inner(p), "")]]
    if r.authors:
        a, b = tagged(inner(r.authors[0]), "")
        texts.append(F.array_join(F.transform("authors", lambda x: F.concat(F.lit(a), safe(x), F.lit(b))), ""))
    return w.select("rec_id", F.concat(F.lit(f"<{root}>"), *(F.coalesce(t, F.lit("")) for t in texts), F.lit(f"</{root}>")).alias("body"))


@query(" UNION ALL ".join(_sql(n, READINGS[n]) for n in XML))
def registry_answers_xml(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d)
    return _union([read_back(xml_answers(w, n), n) for n in XML])

"""BM25 ranking of text units for queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(c: str) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(queries: DataFrame, units: DataFrame, top: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query, unit, score, rank): the best units of each query; ties go to the smaller unit.

    queries: (query, text), a stated set, small against the units; units: (unit, text), and
    a column factor where a unit's scores are multiplied. Only words that some query has are kept of the units, before any shuffle of words.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms("text"))).alias("term"))
    factor = F.col("factor") if "factor" in units.columns else F.lit(1.0)
    sized = units.select("unit", factor.alias("factor"), terms("text").alias("words")).where(F.size("words") > 0)
    total = sized.agg(F.count("*").alias("n_units"), F.avg(F.size("words")).alias("mean_size"))
    vocabulary = asked.select("term").distinct()
    # counts within a unit need no shuffle
    tf = sized.select("unit", "factor", F.size("words").alias("size"), F.explode("words").alias("term")).join(vocabulary, "term", "left_semi").groupBy("unit", "factor", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(total)).select("unit", "factor", "term", weight.alias("w"))  # total is one row
    scored = weighed.join(asked, "term").groupBy("query", "unit").agg(F.round(F.sum("w") * F.first("factor"), 4).alias("score"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "unit")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Words of a cited work's passage that states what kind of thing a claim is about.
CUES = {
    "metric": ("metric", "metrics", "accuracy", "score", "evaluate", "evaluation", "measure", "report", "defined", "definition"),
    "protocol": ("protocol", "procedure", "we evaluate", "setting", "setup", "follow", "pipeline"),
    "split": ("split", "splits", "train", "dev", "test", "validation", "fold"),
    "dataset": ("dataset", "benchmark", "instances", "examples", "statistics", "constructed", "collected", "contains"),
    "setup": ("setup", "setting", "hyperparameter", "configuration", "implementation", "architecture", "trained"),
    "number": ("total", "instances", "examples", "statistics", "contains", "consists"),
    "finding": ("we show", "we find", "we found", "we observe", "our results", "results show", "results suggest", "we demonstrate", "significantly", "outperform", "compared", "increase", "decrease", "associated"),
}


def cue_factor(text: F.Column, kind: str) -> F.Column:
    """What the cues of a kind of claim in a passage multiply its score with: a quarter more for each, up to four, less the penalty of tables."""
    low = F.lower(text)
    hits = sum(low.contains(c).cast("int") for c in CUES[kind])
    return (1 + 0.25 * F.least(F.lit(4), hits)) * tabular_penalty(text)


def tabular_penalty(text: F.Column) -> F.Column:
    """What a passage's score is multiplied with: 0.3 for table rows, 0.6 for mostly signs, else 1."""
    cells, breaks = F.regexp_count(text, F.lit("&")), F.regexp_count(text, F.lit(r"\\\\"))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{2,}"), F.lit(0)))
    every = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return F.when((cells >= 3) | (breaks >= 2), 0.3).when((F.instr(text, "\\begin{tab") > 0) | (words < 0.5 * every), 0.6).otherwise(1.0)

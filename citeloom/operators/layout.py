"""Page layout and passages: words to lines, running heads, reading order, overlap suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(words: DataFrame) -> DataFrame:
    """(doc, page, block, line, x0, y0, x1, y1, text) of words (doc, page, block, line, x, y, w, h, word).

    Words of a line are put in order of x; empty words are left out.
    """
    seen = words.where(F.trim("word") != "")
    g = seen.groupBy("doc", "page", "block", "line").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.array_sort(F.collect_list(F.struct("x", "word"))).alias("ws")
    )
    return g.withColumn("text", F.array_join(F.transform("ws", lambda s: s.word), " ")).drop("ws")


def without_running_heads(rows: DataFrame, top: float = 0.09, bottom: float = 0.07, share: float = 0.25) -> DataFrame:
    """Lines without those at a page's edge whose text, digits masked, repeats over the pages.

    rows: (doc, page, y0, y1, text, page_height). A text repeats on at least two pages and
    a quarter of them.
    """
    mark = F.regexp_replace(F.lower("text"), r"\d+", "#")
    edge = (F.col("y1") <= F.col("page_height") * top) | (F.col("y0") >= F.col("page_height") * (1 - bottom))
    marked = rows.withColumn("_mark", mark).withColumn("_edge", edge)
    pages = rows.groupBy("doc").agg(F.count_distinct("page").alias("_pages"))
    often = marked.where("_edge").groupBy("doc", "_mark").agg(F.count_distinct("page").alias("_n")).join(pages, "doc").where(F.col("_n") >= F.greatest(F.lit(2.0), share * F.col("_pages")))
    drop = often.select("doc", "_mark", F.lit(True).alias("_edge"))
    return marked.join(drop, ["doc", "_mark", "_edge"], "left_anti").drop("_mark", "_edge")


def reading_order(rows: DataFrame) -> DataFrame:
    """rows with `place` from 1 on each page: spanning lines at the top, left column, right column, the rest.

    rows: (doc, page, x0, x1, y0, page_width). A line spans when it crosses the middle of
    the page and is wider than 60 percent of it.
    """
    middle = F.col("page_width") / 2
    spans = (F.col("x0") < middle) & (F.col("x1") > middle) & ((F.col("x1") - F.col("x0")) > 0.6 * F.col("page_width"))
    column = F.when(F.col("x0") >= middle, 2).otherwise(1)
    w = W.partitionBy("doc", "page")
    first = F.min(F.when(~spans, F.col("y0"))).over(w)
    rank = F.when(spans & (first.isNull() | (F.col("y0") < first)), 0).when(spans, 3).otherwise(column)
    ranked = rows.withColumn("_rank", rank)
    return ranked.withColumn("place", F.row_number().over(w.orderBy("_rank", "y0", "x0"))).drop("_rank")


def without_overlap(ranked: DataFrame, group: str) -> DataFrame:
    """Passages kept in order of rank: none that shares lines of a file with a better one kept.

    ranked: (group, rank, file, line_start, line_end); a group holds the few best passages of a query.
    """
    item = F.struct("rank", "file", "line_start", "line_end")
    listed = ranked.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = ranked.select(F.array(item).alias("a")).schema["a"].dataType
    clash = lambda k, x: F.exists(k, lambda y: (y.file == x.file) & (y.line_start <= x.line_end) & (x.line_start <= y.line_end))
    kept = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(group, F.explode(kept).alias("k")).select(group, "k.*")

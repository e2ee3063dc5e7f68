"""Joins and checks of references: lookup, field comparison, duplicates, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as X

# The worth of a field check.
CHECK_WORTH = {"OK": 100.0, "WARN": 60.0, "FAIL": 0.0}


def worth(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "OK", CHECK_WORTH["OK"]).when(status == "WARN", CHECK_WORTH["WARN"]).when(status == "FAIL", CHECK_WORTH["FAIL"])


def year_status(typed: Column, known: Column, by_id: Column) -> Column:
    """OK for equal years, WARN one apart or not comparable, two apart by how it was found, else FAIL."""
    d = F.abs(typed - known)
    return F.when(typed.isNull() | known.isNull(), "WARN").when(d == 0, "OK").when(d == 1, "WARN").when((d == 2) & ~by_id, "WARN").otherwise("FAIL")


def venue_status(typed: Column, known: Column) -> Column:
    """OK for equal or contained venues, WARN otherwise; never FAIL; null where one is missing."""
    contained = (F.length(typed) > 3) & (F.length(known) > 3) & ((F.instr(typed, known) > 0) | (F.instr(known, typed) > 0))
    return F.when(typed.isNull() | known.isNull(), None).when((typed == known) | contained, "OK").otherwise("WARN")


def title_status(likeness: Column) -> Column:
    return F.when(likeness >= 0.85, "OK").when(likeness >= 0.70, "WARN").otherwise("FAIL")


def by_title(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Each reference with the registry row of its exact title: the one with the smallest id.

    Only one registry row per title is joined, so a title that everyone cites stays a
    one-to-many join from that row and adaptive execution can split it.
    """
    key = X.title_key("title")
    one = works.withColumn("title_key", key).where("title_key <> ''").groupBy("title_key").agg(F.min(F.struct("work_id", "year", "venue", "authors", "registry")).alias("w"))
    return refs.withColumn("title_key", key).where("title_key <> ''").join(one, "title_key").select(refs["*"], "w.work_id", F.col("w.year").alias("work_year"), F.col("w.venue").alias("work_venue"), F.col("w.authors").alias("work_authors"), "w.registry")


def field_checks(matched: DataFrame) -> DataFrame:
    """(ref_id, work_id, field, status) in long form: title, year, venue and first author."""
    year = year_status(X.first_year("year"), X.first_year("work_year"), F.lit(False))
    venue = venue_status(X.present(F.lower("venue")), X.present(F.lower("work_venue")))
    first, known = F.lower(X.surname(F.element_at(X.authors("author"), 1))), F.lower(X.surname(F.try_element_at("work_authors", F.lit(1))))
    author = F.when(first.isNull() | known.isNull(), None).when(first == known, "OK").otherwise("FAIL")
    checks = F.array(*(F.struct(F.lit(n).alias("field"), s.alias("status")) for n, s in (("title", F.lit("OK")), ("year", year), ("venue", venue), ("authors", author))))
    return matched.select("ref_id", "work_id", F.explode(checks).alias("c")).select("ref_id", "work_id", "c.field", "c.status").where("status IS NOT NULL")


def match_scores(checks: DataFrame) -> DataFrame:
    """(ref_id, work_id, match_score): mean worth of the checks."""
    return checks.groupBy("ref_id", "work_id").agg(F.round(F.avg(worth("status")), 6).alias("match_score"))


def lookup(refs: DataFrame, answers: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, found_by, found_id): by DOI among the answers, else by title among the works.

    The second join sees only what the first left over.
    """
    doi = F.lower(X.clean_doi("doi"))
    asked = refs.select("ref_id", doi.alias("d"), X.title_key("title").alias("t"))
    known = answers.select(F.lower(X.clean_doi("doi")).alias("d"), "raw_id").where("d IS NOT NULL").groupBy("d").agg(F.min("raw_id").alias("found_id"))
    first = asked.where("d IS NOT NULL").join(known, "d").select("ref_id", F.lit("doi").alias("found_by"), "found_id")
    rest = asked.join(first.select("ref_id"), "ref_id", "left_anti").where("t <> ''")
    titles = works.select(X.title_key("title").alias("t"), "work_id").where("t <> ''").groupBy("t").agg(F.min("work_id").alias("found_id"))
    return first.unionByName(rest.join(titles, "t").select("ref_id", F.lit("title").alias("found_by"), "found_id"))


def audit(cited: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, finding): keys cited but not listed ('phantom') and listed but not cited ('orphan')."""
    a, b = cited.select(key).where(F.col(key).isNotNull()).distinct(), listed.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("phantom").alias("finding")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("orphan").alias("finding")))


def alike_titles(titles: DataFrame, least: float = 0.85) -> DataFrame:
    """(title_a, title_b, likeness): different titles whose words overlap by at least `least`.

    Exact set join with a prefix filter: of a title's words, the rarest that a partner must
    share one of are joined; equal titles are one title before that. Pairs are unordered.
    """
    t = titles.select(X.title_key("title").alias("title")).where("title <> ''").distinct().withColumn("words", X.tokens("title"))
    count = t.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = t.select("title", F.explode("words").alias("word")).join(count, "word").groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x.word).alias("by_rarity"))
    n = F.size("by_rarity")
    prefix = F.slice("by_rarity", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int"))
    marks = ranked.select("title", "by_rarity", F.explode(prefix).alias("word"))
    a = marks.select("word", F.col("title").alias("title_a"), F.col("by_rarity").alias("wa"))
    b = marks.select("word", F.col("title").alias("title_b"), F.col("by_rarity").alias("wb"))
    size = F.size("wa") * least <= F.size("wb")
    met = a.join(b, "word").where(F.col("title_a") < F.col("title_b")).where(size & (F.size("wb") * least <= F.size("wa")))
    return met.select("title_a", "title_b", F.round(X.jaccard("wa", "wb"), 6).alias("likeness")).where(F.col("likeness") >= least).distinct()


def consistency(rows: DataFrame, group: str, value: str, statuses: Column) -> DataFrame:
    """(group, pairs, score): agreement of all pairs of rows of a group, without forming them.

    Rows are counted by value first; a pair of values then stands for the product of the
    counts. statuses is an expression over columns va and vb.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    a = counts.select(group, F.col(value).alias("va"), F.col("n").alias("na"))
    b = counts.select(group, F.col(value).alias("vb"), F.col("n").alias("nb"))
    same = counts.where("n > 1").select(group, (F.col("n") * (F.col("n") - 1) / 2).alias("w"), F.when(F.col(value).isNull(), worth(F.lit("WARN"))).otherwise(worth(F.lit("OK"))).alias("s"))
    # counts of a value are few per group: a group's number of different values bounds the pairs
    met = a.join(b, group).where(F.coalesce(F.col("va"), F.lit(-1)) < F.coalesce(F.col("vb"), F.lit(-1)))
    other = met.select(group, (F.col("na") * F.col("nb")).cast("double").alias("w"), worth(statuses).alias("s"))
    return same.unionByName(other).groupBy(group).agg(F.sum("w").cast("long").alias("pairs"), F.round(F.sum(F.col("w") * F.col("s")) / F.sum("w"), 6).alias("score"))


def first_copies(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in order; equal contents are compared by their hash."""
    return rows.withColumn("_k", key).groupBy("_k").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("_k")


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "7") -> DataFrame:
    """At most n rows per stratum, chosen by a hash of the key: the same on every run.

    The limit is applied inside each partition before the shuffle.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    w = W.partitionBy(*strata).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def budgeted(rows: DataFrame, order: list[Column], size: str, budget: float, group: str) -> DataFrame:
    """Greedy choice in order: an item that would overflow is skipped, smaller later ones may fit.

    Per group, of which each is folded in one place; groups are expected to be small.
    """
    item = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.col("item"), F.col(size).cast("double").alias("size"))
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, x: F.when(acc.used + x["size"] <= budget, F.struct((acc.used + x["size"]).alias("used"), F.concat(acc.kept, F.array(x["item"])).alias("kept"))).otherwise(acc)
    return listed.select(group, F.aggregate("items", start, step).alias("r")).select(group, F.explode("r.kept").alias("item"))


def greedy_matches(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, left_id, right_id): each left row in order takes the first free right row that fits.

    Both sides: (group, id, doi, title). Rows fit by equal DOI or a title likeness of 0.85.
    Order decides, so a group is folded in one place; a group is one paper's list.
    """
    from difflib import SequenceMatcher

    import pandas as pd

    sides = left.select(group, F.lit(0).alias("side"), F.col("id").cast("long"), "doi", "title").unionByName(right.select(group, F.lit(1).alias("side"), F.col("id").cast("long"), "doi", "title"))
    kind = sides.schema[group].dataType.simpleString()

    def fits(a: tuple, b: tuple) -> bool:
        if a[1] and b[1]:
            return a[1].lower() == b[1].lower()
        return bool(a[2] and b[2]) and SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio() >= 0.85

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        mine, free = ([tuple(r) for r in rows.loc[rows.side == s, ["id", "doi", "title"]].itertuples(index=False)] for s in (0, 1))
        out = []
        for a in mine:
            k = next((k for k, b in enumerate(free) if fits(a, b)), None)
            if k is not None:
                out.append((key[0], a[0], free.pop(k)[0]))
        return pd.DataFrame(out, columns=[group, "left_id", "right_id"])

    return sides.where(F.col(group).isNotNull()).groupBy(group).applyInPandas(run, f"{group} {kind}, left_id long, right_id long")


def hyphen_breaks(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, left, right, joined): words cut by a hyphen and a space, and whether the whole word is known.

    texts: (id, text); vocabulary: (word) without repeats.
    """
    cut = F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}{2,}- \p{Ll}{2,})"), F.lit(1)))
    parts = texts.select("id", cut.alias("c")).select("id", F.split_part("c", F.lit("- "), F.lit(1)).alias("left"), F.split_part("c", F.lit("- "), F.lit(2)).alias("right"))
    known = vocabulary.select("word", F.lit(True).alias("k"))
    met = parts.withColumn("word", F.lower(F.concat("left", "right"))).join(known, "word", "left")
    return met.select("id", "left", "right", F.coalesce("k", F.lit(False)).alias("joined"))


def shared_stretches(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """(left id, right id) of texts that share n successive words; both sides are (id, text).

    Stretches are compared by a 64-bit hash; of the larger side only those the smaller one
    has travel further than a filter.
    """
    a, b = left.columns[0], right.columns[0]

    def stretches(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)).alias("w")).where(F.size("w") >= n)
        each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda k: F.xxhash64(F.slice("w", k, n)))
        return words.select(key, F.explode(F.array_distinct(each)).alias("g"))

    return stretches(left, a).join(stretches(right, b), "g").select(a, b).distinct()

"""Verification of references: lookups and searches, field checks, flags and status.

A reference meets the registries twice: by its identifier, which is an equi-join, and by a
search for its title, a set-similarity join that keeps the best hit of each registry. Every
hit becomes a source match with a status and a score for each field that both sides have;
all verdicts are aggregates over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.similarity import jaro_winkler
from citeloom.operators.references import title_status, worth
from citeloom.session import cut

SEARCH_LEAST = 0.60
#: likeness of titles at which other authors are no objection
SURE_TITLE = 0.85
#: works with a word from which it is frequent, and how many frequent words there are at most
OFTEN, MOST_FREQUENT = 64, 1 << 15
#: shares of the larger side of a join of patterns
SHARES = 16
# Registries that a search asks first, in this order.
PRIORITY = ("semantic_scholar", "openalex", "crossref", "arxiv", "pubmed", "dblp", "europe_pmc", "datacite")
# Points of a flag at full confidence.
FLAG_POINTS = {"phantom_doi": 40, "phantom_arxiv": 35, "no_registry_match": 30, "author_title_chimera": 25, "temporal_impossibility": 20, "format_anomaly": 10}
MODERN = ("neurips", "nips", "iclr", "arxiv")


def first_surname(names: Column | str) -> Column:
    """The folded surname of the first name, null where there is none."""
    names = F.col(names) if isinstance(names, str) else names
    return F.nullif(X.fold_accents(X.surname(F.try_element_at(names, F.lit(1)))), F.lit(""))


def whole_year(c: Column | str) -> Column:
    """A year typed as digits only; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\s*\d{1,4}\s*$"), F.trim(c).cast("int"))


def search(refs: DataFrame, works: DataFrame, often: int = OFTEN, longs: int = 8) -> DataFrame:
    """(ref_id, registry, work_id, likeness): of each registry the work most like a reference's title.

    refs: (ref_id, title, authors, year). works: (work_id, registry, title, authors, year).
    Hits have a token likeness of SEARCH_LEAST. Where both first surnames are known and
    differ, a hit needs SURE_TITLE and years less than two apart. Ties go to the smaller
    work_id. Rows without words in the title match nothing.

    Titles of equal words, first surname and year are one form on either side. Words that
    fewer than `often` works have bring forms together themselves, one surname those of a
    surname. All other hits share frequent words only, so there a title counts as the pattern
    of its frequent words and its number of words: patterns are few, and for each one the
    smallest work_id of a registry speaks. Likeness of patterns leaves rare words out, so it
    is the titles' own or less, and where it is less, the rare words bring the titles together.
    """
    keys = [X.title_key("title").alias("title"), first_surname("authors").alias("first"), whole_year("year").alias("y")]
    words = F.array_sort(F.array_distinct(F.split("title", " "))).alias("words")
    a = cut(refs.select("ref_id", *keys).where("title <> ''").select("ref_id", words, "first", "y").withColumn("id", F.xxhash64("words", "first", "y")))
    forms = a.groupBy("id").agg(*(F.first(c).alias(c) for c in ("words", "first", "y")))
    b = cut(works.select("work_id", "registry", *keys).where("title <> ''").groupBy("registry", words, "first", "y").agg(F.min("work_id").alias("id")))
    count = cut(b.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    # so many words at most are frequent, at any size
    least = max(often, (count.agg(F.sum("n")).first()[0] or 0) // MOST_FREQUENT)
    frequent = cut(count.where(F.col("n") >= least).select("word", (F.row_number().over(W.orderBy("n", "word")) - 1).alias("k")))
    size = frequent.count()

    def coded(side: DataFrame, *kept: str) -> DataFrame:
        each = side.select("id", *kept, F.explode("words").alias("word")).join(frequent, "word", "left")
        g = each.groupBy("id", *kept).agg(F.array_sort(F.collect_list("k")).alias("ids"), F.collect_list(F.when(F.col("k").isNull(), F.col("word"))).alias("rare"))
        return cut(g.withColumn("n", F.size("ids") + F.size("rare")))

    r, w = coded(forms, "first", "y"), coded(b, "registry", "first", "y")
    # titles of one rare word, or of one surname and a word that SEARCH_LEAST makes them share
    met = r.select(F.col("id").alias("form"), F.explode("rare").alias("word")).join(w.select(F.col("id").alias("work_id"), F.explode("rare").alias("word")), "word").select("form", "work_id")
    named = lambda side, name: side.where("first IS NOT NULL").select(F.col("id").alias(name), "first", F.explode(_marks(SEARCH_LEAST)).alias("mark"))
    met = met.unionByName(named(r, "form").join(named(w, "work_id"), ["first", "mark"]).select("form", "work_id")).distinct()
    left = r.select(F.col("id").alias("form"), F.col("ids").alias("ia"), F.col("rare").alias("ra"), F.col("n").alias("na"), F.col("first").alias("fa"), F.col("y").alias("ya"))
    right = w.select(F.col("id").alias("work_id"), "registry", F.col("ids").alias("ib"), F.col("rare").alias("rb"), F.col("n").alias("nb"), F.col("first").alias("fb"), F.col("y").alias("yb"))
    common = F.size(F.array_intersect("ia", "ib")) + F.size(F.array_intersect("ra", "rb"))
    both = met.join(left, "form").join(right, "work_id").withColumn("likeness", common / (F.col("na") + F.col("nb") - common))
    rated = both.where((F.col("likeness") >= SEARCH_LEAST) & plausible(F.col("fa"), F.col("fb"), F.col("ya"), F.col("yb"), F.col("likeness"))).select("form", "registry", "likeness", "work_id")

    # patterns: one side without authors, or near years and a sure title
    r = r.withColumn("p", F.xxhash64("ids", "n"))
    no, some = r.where("first IS NULL"), r.where("first IS NOT NULL")
    of = lambda side, *kept: side.groupBy("ids", "n", "registry", *kept).agg(F.min("id").alias("work_id"))
    bits = (min(longs, size // 64 + 1), size <= 64 * longs)
    loose = _alike(no.select("p", "ids", "n").distinct(), of(w), SEARCH_LEAST, bits, many_right=True)
    closed = _alike(some.select("p", "ids", "n").distinct(), of(w.where("first IS NULL")), SEARCH_LEAST, bits)
    sure = _alike(some.select("p", "y", "ids", "n").distinct(), of(w, "y"), SURE_TITLE, bits, years=True)
    as_form = lambda side, hits, on: side.select(F.col("id").alias("form"), "p", "y").join(hits, on).select("form", "registry", "likeness", "work_id")
    near = sure.withColumnRenamed("p", "q").withColumnRenamed("y", "z")
    rated = rated.unionByName(as_form(no, loose, "p")).unionByName(as_form(some, closed, "p")).unionByName(as_form(some, near, (F.col("p") == F.col("q")) & F.col("y").eqNullSafe(F.col("z"))))
    best = rated.groupBy("form", "registry").agg(F.max(F.struct("likeness", (-F.col("work_id")).alias("w"))).alias("x"))
    best = best.select("form", "registry", (-F.col("x.w")).alias("work_id"), F.round("x.likeness", 6).alias("likeness"))
    return a.select("ref_id", F.col("id").alias("form")).join(best, "form").select("ref_id", "registry", "work_id", "likeness")


def _marks(least: float) -> Column:
    """The rarest frequent words, as many that titles of that likeness and no common rare word share one of them."""
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    return F.slice("ids", F.lit(1), F.greatest(F.size("ids") - need + 1, F.lit(0)).cast("int"))


def _alike(left: DataFrame, right: DataFrame, least: float, bits: tuple[int, bool], many_right: bool = False, years: bool = False) -> DataFrame:
    """(p, registry, likeness, work_id), with years also y: patterns with a likeness of least, the smallest work_id for each likeness.

    left: (p, ids, n); right: (ids, n, registry, work_id); with years both have y, and years
    two or more apart do not meet. bits: the longs that hold a pattern, and whether each word
    has its own bit; else the bits tell only the most that may be common. The smaller side is
    copied to SHARES shares of the other, for few words lead many patterns together.
    """
    longs, own = bits
    # so many words may be on one side only; no rare word is on both
    spare = F.floor(F.col("n") * ((1 - least) / least) + 1e-9).cast("int")
    rare = F.col("n") - F.size("ids")
    bit = lambda j: F.expr(f"aggregate(ids, 0L, (a, x) -> CASE WHEN (x div 64) % {longs} = {j} THEN a | shiftleft(1L, CAST(x % 64 AS INT)) ELSE a END)").alias(f"s{j}")
    all_shares, one_share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))), F.pmod(F.xxhash64("ids", "n"), F.lit(SHARES)).cast("int")

    def side(df: DataFrame, budget: Column, share: Column, tag: str) -> DataFrame:
        x = df.where(rare <= spare).select("*", *(bit(j) for j in range(longs)), budget.alias("rares")).withColumn("mark", F.explode(_marks(least))).withColumn("share", share)
        x = x.select("mark", "rares", "share", *(F.col(c).alias(f"{c}{tag}") for c in (*df.columns, *(f"s{j}" for j in range(longs)))))
        return x.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mark", "rares", "share")

    x = side(left, F.explode(F.sequence(F.lit(0), spare - rare)), all_shares if many_right else one_share, "_a")
    y = side(right, rare, one_share if many_right else all_shares, "_b")
    ones = lambda f: sum((F.bit_count(f(j)) for j in range(1, longs)), F.bit_count(f(0)))
    most = ones(lambda j: F.col(f"s{j}_a").bitwiseAND(F.col(f"s{j}_b")))
    if not own:
        most = most + F.size("ids_a") - ones(lambda j: F.col(f"s{j}_a"))
    like = lambda c: c / (F.col("n_a") + F.col("n_b") - c)
    near = F.coalesce(F.abs(F.col("y_a") - F.col("y_b")) < 2, F.lit(True)) if years else F.lit(True)
    met = x.hint("shuffle_hash").join(y, ["mark", "rares", "share"]) if many_right else x.join(y.hint("shuffle_hash"), ["mark", "rares", "share"])
    met = met.where((like(most) >= least) & near).withColumn("likeness", like(most if own else F.size(F.array_intersect("ids_a", "ids_b")))).where(F.col("likeness") >= least)
    kept = [F.col("p_a").alias("p"), *([F.col("y_a").alias("y")] if years else []), F.col("registry_b").alias("registry")]
    return met.groupBy(*kept, "likeness").agg(F.min("work_id_b").alias("work_id"))


def plausible(first_a: Column, first_b: Column, year_a: Column, year_b: Column, likeness: Column) -> Column:
    """Whether an answer may be the reference's: unknown or equal first surnames, or near years and a sure title."""
    near = F.coalesce(F.abs(year_a - year_b) < 2, F.lit(True))
    return first_a.isNull() | first_b.isNull() | (first_a == first_b) | (near & (likeness >= SURE_TITLE))


def authors_status(typed: Column, known: Column, likeness: Column) -> Column:
    """OK for a like first surname and numbers of authors at most two apart, WARN for the surname alone; null where a side has none."""
    others = F.exists(typed, lambda x: F.lower(x).contains("others") | F.lower(x).contains("et al"))
    number = others | (F.abs(F.size(typed) - F.size(known)) <= 2)
    return F.when((F.size(typed) < 1) | (F.size(known) < 1) | typed.isNull() | known.isNull(), None).when((likeness >= 0.9) & number, "OK").when(likeness >= 0.9, "WARN").otherwise("FAIL")


def years_status(typed: Column, known: Column, by_id: Column) -> Column:
    """OK for one year, WARN one apart or not comparable, two apart by how it was found, else FAIL."""
    a, b = whole_year(typed), whole_year(known)
    d = F.abs(a - b)
    return F.when(X.present(typed).isNull() | X.present(known).isNull(), None).when(d.isNull() | (d == 1), "WARN").when(d == 0, "OK").when((d == 2) & ~by_id, "WARN").otherwise("FAIL")


def venues_status(typed: Column, known: Column, likeness: Column) -> Column:
    """OK for alike, contained or both arXiv's venues, WARN otherwise; null where one is missing. Of venue_name of both."""
    preprint = (typed.contains("arxiv") | typed.contains("corr")) & (known.contains("arxiv") | known.contains("corr"))
    inside = (F.length(typed) > 3) & (F.length(known) > 3) & (typed.contains(known) | known.contains(typed))
    return F.when(typed.isNull() | known.isNull(), None).when(preprint | inside | (likeness >= 0.5), "OK").otherwise("WARN")


def source_matches(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per reference and source with status and score of each field, match_score and confirmed.

    refs: (ref_id, title, authors, year, venue). hits: (ref_id, registry, by_id, etitle,
    eauthors, eyear, evenue, retracted). A field that a side lacks has null status; a hit by
    identifier that is not plausible is left out. What is read from a text is a column of its
    own, so it is read once.
    """
    m = hits.join(refs, "ref_id").withColumns({"fa": first_surname("authors"), "fb": first_surname("eauthors"), "ta": X.tokens("title"), "tb": X.tokens("etitle"), "ya": whole_year("year"), "yb": whole_year("eyear")})
    m = m.withColumn("title_score", F.when(X.present("title").isNotNull() & X.present("etitle").isNotNull(), X.jaccard("ta", "tb")))
    m = m.where(plausible(F.col("fa"), F.col("fb"), F.col("ya"), F.col("yb"), F.coalesce("title_score", F.lit(0.0))))
    m = m.withColumn("author_score", F.when(F.col("fa") == F.col("fb"), 1.0).otherwise(F.coalesce(jaro_winkler("fa", "fb"), F.lit(0.0))))
    given = lambda c: F.when(X.present(c).isNotNull(), X.venue_name(c))
    m = m.withColumns({"va": given("venue"), "vb": given("evenue"), "pa": X.tokens("venue"), "pb": X.tokens("evenue")})
    m = m.withColumns({"names_alike": X.jaccard(X.tokens("va"), X.tokens("vb")), "venues_alike": X.jaccard("pa", "pb")})
    author = F.when(F.col("fa").isNull() | F.col("fb").isNull(), F.when((F.size("authors") > 0) & (F.size("eauthors") > 0), "WARN")).otherwise(authors_status(F.col("authors"), F.col("eauthors"), F.col("author_score")))
    status = {"title": F.when(F.col("title_score").isNotNull(), title_status(F.col("title_score"))), "authors": author, "year": years_status(F.col("year"), F.col("eyear"), F.col("by_id")), "venue": venues_status(F.col("va"), F.col("vb"), F.col("names_alike"))}
    m = m.select("*", *(s.alias(f"{k}_status") for k, s in status.items()))
    away = F.abs(F.col("ya") - F.col("yb"))
    year_score = F.when(F.col("year_status").isNotNull(), F.coalesce(F.greatest(F.lit(0.0), 1 - 0.5 * away), F.lit(0.5)))
    venue_score = F.when(F.col("venue_status") == "OK", F.greatest("venues_alike", F.lit(0.8))).when(F.col("venue_status").isNotNull(), F.col("venues_alike"))
    worths = F.array_compact(F.array(*(worth(f"{k}_status") for k in status)))
    score = F.when(F.size(worths) > 0, F.aggregate(worths, F.lit(0.0), lambda a, x: a + x) / F.size(worths)).otherwise(0.0)
    sure = F.coalesce(F.col("title_status") == "OK", F.lit(False)) & F.coalesce(F.col("authors_status").isin("OK", "WARN"), F.lit(False))
    return m.select(
        "ref_id", "registry", "by_id", "retracted", *(f"{k}_status" for k in status), F.round("title_score", 6).alias("title_score"), F.when(F.col("authors_status").isNotNull(), F.round("author_score", 6)).alias("author_score"),
        F.round(year_score, 6).alias("year_score"), F.round(venue_score, 6).alias("venue_score"), F.round(score, 6).alias("match_score"), sure.alias("confirmed"), (F.col("fa") == F.col("fb")).alias("same_first"),
    )


def stop_early(matches: DataFrame, enough: int = 2) -> DataFrame:
    """The matches a search in registry order would have seen: none after `enough` confirmed ones without a failed field."""
    order = F.coalesce(*(F.when(F.col("registry") == n, F.lit(k)) for k, n in enumerate(PRIORITY)), F.lit(len(PRIORITY)))
    clean = F.col("confirmed") & ~F.greatest(*(F.coalesce(F.col(f"{k}_status") == "FAIL", F.lit(False)).cast("int") for k in ("title", "authors", "year", "venue"))).cast("boolean")
    w = W.partitionBy("ref_id").orderBy(order, "registry").rowsBetween(W.unboundedPreceding, -1)
    return matches.withColumn("_seen", F.coalesce(F.sum(clean.cast("int")).over(w), F.lit(0))).where(F.col("_seen") < enough).drop("_seen")


def composite(matches: DataFrame) -> DataFrame:
    """(ref_id, existence, title, author, venue, overall, label) from the best source and the best scores."""
    best = F.max(F.struct("match_score", "by_id")).alias("best")
    g = matches.groupBy("ref_id").agg(best, *(F.coalesce(F.max(f"{k}_score"), F.lit(0.0)).alias(k) for k in ("title", "author", "venue")))
    existence = F.when(F.col("best.by_id"), 1.0).when(F.col("best.match_score") >= 85, 0.9).when(F.col("best.match_score") >= 60, 0.6).otherwise(0.3)
    g = g.withColumn("existence", existence)
    overall = 0.35 * F.col("existence") + 0.25 * F.col("title") + 0.15 * F.col("author") + 0.10 * F.col("venue") + 0.15 * 0.5
    g = g.withColumn("overall", F.round(overall, 6))
    return g.select("ref_id", "existence", "title", "author", "venue", "overall", F.when(F.col("overall") >= 0.85, "supported").when(F.col("overall") >= 0.60, "possible").otherwise("suspicious").alias("label"))


def overall(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """(ref_id, sources, confirmed, status): the worst field of the confirmed sources, else of all; no source is FAIL.

    A year that fails at sources found by search only is a warning where all else of the
    confirmed sources holds. A retraction at any source is FAIL.
    """
    field = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"{k}_status").alias("s")) for k in ("title", "authors", "year", "venue")))).alias("c")
    long = matches.select("ref_id", "by_id", "confirmed", "retracted", field).select("*", "c.f", "c.s")
    bad = lambda s: F.coalesce(F.col("s") == s, F.lit(False))
    mild = bad("FAIL") & (F.col("f") == "year") & ~F.col("by_id")
    g = long.groupBy("ref_id").agg(
        F.bool_or("confirmed").alias("any"), F.bool_or(F.coalesce("retracted", F.lit(False))).alias("retracted"), F.bool_or(F.col("confirmed") & bad("FAIL") & ~mild).alias("hard"),
        F.bool_or(F.col("confirmed") & (bad("WARN") | mild)).alias("soft"), F.bool_or(bad("FAIL")).alias("fail"), F.bool_or(bad("WARN")).alias("warn"),
    )
    n = matches.groupBy("ref_id").agg(F.count("*").alias("sources"), F.count_if("confirmed").alias("confirmed"))
    sure = F.when(F.col("hard"), "FAIL").when(F.col("soft"), "WARN").otherwise("OK")
    rest = F.when(F.col("fail"), "FAIL").when(F.col("warn"), "WARN").otherwise("OK")
    status = F.when(F.col("any").isNull() | F.col("retracted"), "FAIL").when(F.col("any"), sure).otherwise(rest)
    return refs.select("ref_id").join(g, "ref_id", "left").join(n, "ref_id", "left").select("ref_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"), status.alias("status"))


def hallucination_flags(refs: DataFrame, matches: DataFrame, last_year: int) -> DataFrame:
    """(ref_id, flag, confidence) of references (ref_id, bib_file, title, doi, arxiv_id, year, venue) that look invented."""
    of = matches.groupBy("ref_id").agg(
        F.count("*").alias("n"), F.bool_or("by_id").alias("by_id"), F.bool_or(F.col("registry") == "arxiv").alias("arxiv"), F.bool_or(F.coalesce(F.col("same_first"), F.lit(False)) & F.coalesce(F.col("title_score") < 0.5, F.lit(False))).alias("chimera")
    )
    lists = refs.groupBy("bib_file").agg(F.count("*").alias("refs"), F.avg(F.coalesce(F.length("title") - F.length(F.replace("title", F.lit(":"), F.lit(""))) == 1, F.lit(False)).cast("double")).alias("share"))
    no = F.lit(False)
    r = refs.join(of, "ref_id", "left").join(lists, "bib_file", "left").withColumn("some", F.coalesce(F.col("n") > 0, no)).withColumn("id_found", F.coalesce("by_id", no))
    year, venue = whole_year("year"), F.lower(F.coalesce("venue", F.lit("")))
    modern = F.greatest(*(venue.contains(v).cast("int") for v in MODERN)) == 1
    flags = {
        "phantom_doi": (X.clean_doi("doi").isNotNull() & ~F.col("id_found"), F.when(F.col("some"), 0.85).otherwise(0.95)),
        "phantom_arxiv": (F.col("arxiv_id").rlike(r"^\d{4}\.\d{4,5}") & ~F.coalesce("arxiv", no), F.when(F.col("some"), 0.80).otherwise(0.90)),
        "no_registry_match": ((F.length("title") >= 10) & ~F.col("id_found"), F.when(F.col("some"), 0.4).otherwise(0.7)),
        "author_title_chimera": (F.coalesce("chimera", no), F.lit(0.7)),
        "temporal_impossibility": ((year > last_year + 1) | ((year < 1990) & modern), F.when(year > last_year + 1, 0.95).otherwise(0.6)),
        "format_anomaly": ((F.col("refs") >= 5) & (F.col("share") > 0.7) & F.col("title").contains(":"), F.lit(0.3)),
    }
    rows = F.array_compact(F.array(*(F.when(F.coalesce(c, no), F.struct(F.lit(k).alias("flag"), s.cast("double").alias("confidence"))) for k, (c, s) in flags.items())))
    return r.select("ref_id", F.explode(rows).alias("x")).select("ref_id", "x.flag", "x.confidence")


def hallucination_scores(flags: DataFrame, points: dict[str, int] = FLAG_POINTS) -> DataFrame:
    """(ref_id, flags, score, likely): points of the flags by confidence, 100 at most; 50 and more is likely invented."""
    table = F.create_map(*(F.lit(x) for kv in points.items() for x in kv))
    s = flags.groupBy("ref_id").agg(F.count("*").alias("flags"), F.round(F.least(F.lit(100.0), F.sum(F.coalesce(table[F.col("flag")], F.lit(10)) * F.col("confidence"))), 6).alias("score"))
    return s.withColumn("likely", F.col("score") >= 50)


def kill_shot(tier: Column, probability: Column, score: Column, legacy: bool = False) -> tuple[Column, Column]:
    """(tier, probability) lifted to high where the reference is likely invented.

    legacy: as first published, where every tier, critical ones too, becomes HIGH.
    """
    hit = F.coalesce(score >= 50, F.lit(False))
    low = hit if legacy else hit & tier.isin("low", "elevated")
    return F.when(low, F.lit("HIGH" if legacy else "high")).otherwise(tier), F.when(low, F.greatest(probability, score / 100)).otherwise(probability)


def fallback_tier(status: Column, label: Column) -> Column:
    """The tier without fusion: from the status of the reference, then from a contradicted claim."""
    return F.when(status == "FAIL", "high").when(status == "WARN", "elevated").when(label == "CONTRADICTED", "high").otherwise("low")


def claim_risk(label: Column, confidence: Column) -> Column:
    """Risk of a claim by its label: critical, high, medium, unknown or low."""
    return F.when(label == "CONTRADICTED", "critical").when(label == "UNSUPPORTED", F.when(confidence > 0.7, "high").otherwise("medium")).when(label == "PARTIALLY_SUPPORTED", "medium").when(label == "UNVERIFIABLE", "unknown").otherwise("low")

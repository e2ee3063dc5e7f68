"""Copies hidden by layout, by progressive partition refinement.

Records are first grouped by how many letters and digits they have that no change of layout
touches, then, only inside classes with several members, by the histogram of those letters,
and last, only inside what is still together, by costlier keys, which read the fields and
put them into one order. Records alone in their class end where they are alone. All keys
are Spark SQL expressions; only a text with its title before the authors is compared with
the texts of its class by an Arrow function.

Null or empty texts are no case; equal texts are copies of one another; ties go to the
smallest id. Extra columns play no part. Empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import cut

SPACE = r"[\s\u00a0\u2000-\u200d\u202f\u2060\u3000\ufeff\u00ad]+"
NOT_LETTERS = r"[^\p{L}\p{M}\p{N}]+"
DOI_LEAD = r"(?i)^\s*(?:(?:https?\s*:\s*/\s*/\s*)?(?:dx\s*\.\s*)?(?:www\s*\.\s*)?doi\s*\.\s*org\s*/|doi\b\s*:?)\s*"
DOI_IN_TEXT = r"(?i)(?:https?\s*:\s*/\s*/\s*(?:dx\s*\.\s*)?doi\s*\.\s*org\s*/\s*|(?<![\p{L}\p{N}])doi\s*:?\s*)?(?<![\p{L}\p{N}])10\.\d{4,9}\s*/\s*[^\s\"<>,;]+"


#: letters that no DOI prefix or resolver address holds, and digits
HISTOGRAM = "aenul0123456789"


def letters(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), NOT_LETTERS, "")


def plain_doi(doi: Column) -> Column:
    """A DOI without resolver, prefix, case and punctuation; '' where it is missing."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(doi, F.lit("")), DOI_LEAD, ""), DOI_LEAD, "")
    return letters(bare)


def histogram(text: Column, marks: str = HISTOGRAM) -> Column:
    """A hash of how often each mark stands in the text, in either case."""
    low = F.lower(text)
    return F.xxhash64(*(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in marks))


#: everything but digits and letters that a DOI prefix or resolver address may bring
NOT_STRIPPED = "[^abcefjklmnquvyz0-9]+"


def stripped_length(text: Column) -> Column:
    """How many plain letters and digits a text has, without those a DOI prefix may bring."""
    return F.length(F.regexp_replace(F.lower(text), NOT_STRIPPED, ""))


def several(rows: DataFrame, key: Column) -> DataFrame:
    """The rows whose class under the key has more than one member, with the key as inv."""
    keyed = cut(rows.withColumn("inv", key))
    classes = keyed.groupBy("inv").agg(F.count("*").alias("_n")).where("_n > 1").select("inv")
    return keyed.join(classes, "inv", "left_semi")


def pairs(keyed: DataFrame) -> DataFrame:
    """(keep_id, copy_id, copies) of rows (id, key); copies counts the group's other rows.

    Groups are counted with partial sums before the shuffle; the join back to the rows has
    one row per group on its other side, so adaptive execution can split a hot group.
    """
    keyed = cut(keyed)  # counted first, then joined
    groups = keyed.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("_n")).where("_n > 1")
    joined = keyed.join(groups, "key")
    return joined.where("id > keep_id").select("keep_id", F.col("id").alias("copy_id"), (F.col("_n") - 1).alias("copies"))


def digest(*parts: Column | str) -> Column:
    """A 128-bit key."""
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def bib_copies(refs: DataFrame) -> DataFrame:
    """Copies among typed references: equal title and DOI but for layout.

    A missing DOI equals only a missing one; references without a title are no case.
    """
    named = refs.select(F.col("ref_id").alias("id"), "title", "doi").where(F.trim("title") != "")
    lengths = several(named, F.length(letters(F.col("title"))))
    classed = several(lengths, histogram(F.col("title"), f"{HISTOGRAM}diopt"))
    keyed = classed.select("id", letters(F.col("title")).alias("t"), plain_doi(F.col("doi")).alias("d"))
    return pairs(keyed.where("t <> ''").select("id", digest("t", "d").alias("key")))


# The five layouts, told apart by where the year stands:
#   A  authors (year). title. venue, volume(issue), pages.
#   B  authors. title. venue volume(issue):pages, year.
#   C  title. authors. venue, year; volume(issue): pages.
#   D  year. authors, "title," venue volume, issue, pages.
#   E  authors: title [year] venue; volume/issue, pages
# In all but C the fields stand in the same order once year and DOI are taken out. Other
# layouts with that order are read too: their year is the first in brackets, before a
# semicolon, or standing alone.
_Y = r"(?:1[5-9]|20)\d\d[a-z]?"
YEAR = rf"^\W*{_Y}\s*\.\s|\(\s*{_Y}\s*\)\s*\.|\[\s*{_Y}\s*\]|,\s*{_Y}\s*;|,\s*{_Y}\s*\.?\s*$"

ANY_YEAR = rf"\(\s*{_Y}\s*\)|(?<![\p{{L}}\p{{N}}]){_Y}\s*;|(?<![\p{{L}}\p{{N}}–:-]){_Y}(?![\p{{L}}\p{{N}}]|\s*[-–])"


def _without_first(text: Column, found: Column) -> Column:
    """text without the first occurrence of the string `found`, a space in its place."""
    at = F.instr(text, found)
    return F.when(found == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(found), F.length(text))))


def _sequence(text: Column) -> Column:
    """Letters and digits in order; numbers that followed one another stay apart."""
    apart = F.regexp_replace(F.lower(text), r"(?<=\p{N})[^\p{L}\p{M}\p{N}]+(?=\p{N})", "|")
    return F.regexp_replace(apart, r"[^\p{L}\p{M}\p{N}|]+|(?<!\p{N})\|+|\|+(?!\p{N})", "")


def entry_fields(entries: DataFrame) -> DataFrame:
    """(id, inv, year, doi, rest, head): the parts of a reference text that can move.

    rest is the text without year and DOI; head, in layout C only, what precedes the year.
    """
    e = entries.select("id", "inv", F.regexp_replace("raw", SPACE, " ").alias("s"))
    e = e.withColumn("d", F.regexp_extract("s", DOI_IN_TEXT, 0))
    # a DOI at the end takes along no closing period
    e = e.withColumn("d", F.regexp_replace("d", r"[.\s]+$", "")).withColumn("s", F.trim(_without_first(F.col("s"), F.col("d"))))
    e = e.withColumn("y", F.coalesce(F.nullif(F.regexp_extract("s", YEAR, 0), F.lit("")), F.regexp_extract("s", ANY_YEAR, 0)))
    head = F.when(F.col("y").startswith(",") & F.col("y").endswith(";"), F.substring("s", F.lit(1), F.instr("s", F.col("y")) - 1))
    return e.select("id", "inv", letters(F.col("y")).alias("year"), plain_doi(F.col("d")).alias("doi"), _without_first(F.col("s"), F.col("y")).alias("rest"), head.alias("head"))


def joined(parts: list[str]) -> str:
    """Sequences one after the other; numbers that follow one another stay apart."""
    out = ""
    for x in parts:
        out += f"|{x}" if x and out and out[-1].isnumeric() and x[0].isnumeric() else x
    return out


def turned_into(pieces: list[str], tail: str, other: str) -> bool:
    """Whether a text with its title first, cut into pieces, is the other with its authors first.

    The title may end at any piece, for it may hold single letters too, the authors at any
    after it; where the other does not go on as the authors would, nothing is tried.
    """
    for i in range(1, len(pieces) - 1):
        authors = ""
        for j in range(i + 1, len(pieces)):
            authors = joined([authors, pieces[j - 1]])
            if not other.startswith(authors):
                break
            if joined([authors, *pieces[:i], *pieces[j:], tail]) == other:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def _turned(pieces, tail, other):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([turned_into(list(p), t, o) for p, t, o in zip(pieces, tail, other)], dtype=bool)


def entry_copies(entries: DataFrame, id_col: str = "entry_id", raw_col: str = "raw") -> DataFrame:
    """Copies among scanned reference texts: the same fields in another order or layout.

    Layout C has the title before the authors. Inside its class such a text is compared
    with the different texts of the other layouts; where it is one of them with its
    authors put first, that text's key holds, else the records keep a key of their own.
    """
    texts = entries.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")).where(F.trim(raw_col) != "")
    lengths = several(texts, stripped_length(F.col("raw")))
    members = several(lengths, histogram(F.col("raw")))
    f = cut(entry_fields(members).select("id", F.xxhash64("inv", "year", "doi").alias("class"), "year", "doi", "head", "rest", _sequence(F.col("rest")).alias("seq")))
    straight = f.where("head IS NULL").select("id", "class", "seq", digest("year", "doi", "seq").alias("key"))
    turned = f.where("head IS NOT NULL").withColumn("own", digest("year", "doi", F.concat(F.lit("C:"), "seq")))
    # one row per distinct text on both sides
    pieces = F.transform(F.split("head", r"(?<=\.) "), _sequence)
    tail = _sequence(F.substring("rest", F.length("head") + 1, F.length("rest")))
    once = turned.groupBy("own").agg(F.first("class").alias("class"), F.first("head").alias("head"), F.first("rest").alias("rest")).select("own", "class", pieces.alias("pieces"), tail.alias("tail")).where(F.size("pieces") > 2)
    others = straight.groupBy("key").agg(F.first("class").alias("class"), F.first("seq").alias("seq"))
    same = once.join(others, "class").where(_turned("pieces", "tail", "seq")).groupBy("own").agg(F.min("key").alias("_other"))
    turned_keys = turned.select("id", "own").join(same, "own", "left").select("id", F.coalesce("_other", "own").alias("key"))
    return pairs(straight.select("id", "key").unionByName(turned_keys))


def found(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, keep_id, copy_id) over both tables."""
    a = bib_copies(refs).select(F.lit("bib_references").alias("src"), "keep_id", "copy_id")
    b = entry_copies(entries).select(F.lit("pdf_ref_entries").alias("src"), "keep_id", "copy_id")
    return a.unionByName(b)

"""Column functions on reference texts; all stay in the JVM and inside code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column | str) -> Column:
    """The trimmed text, null where it is null or empty: '' stands for a missing value."""
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_key(c: Column | str) -> Column:
    """ASCII words in lower case with one space between them; the key of exact title joins."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column | str) -> Column:
    """Different ASCII words, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Common over all elements of two arrays without repeats; 0 where both are empty."""
    common = F.array_size(F.array_intersect(a, b))
    every = F.array_size(a) + F.array_size(b) - common
    return F.when(every > 0, common / every).otherwise(F.lit(0.0))


def surname(name: Column | str) -> Column:
    """The last word before a comma, else the last word."""
    name = F.col(name) if isinstance(name, str) else name
    return F.element_at(F.split(squeeze(F.split_part(name, F.lit(","), F.lit(1))), " "), -1)


# letters with an accent and the plain letter, by rule
_ACCENTED = {chr(c): d[0].lower() for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) for d in [unicodedata.normalize("NFD", chr(c))] if d[0].isascii() and d[0].isalpha() and len(d) > 1} | {"ı": "i"}


def fold_accents(c: Column | str) -> Column:
    """Lower case without accents, composed or combining."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), "".join(_ACCENTED), "".join(_ACCENTED.values()))


def authors(c: Column | str) -> Column:
    """Names of an author field that joins them with the word `and`."""
    return F.filter(F.transform(F.split(c, r"\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def clean_doi(c: Column | str) -> Column:
    """A DOI without its resolver or prefix, null where what is left is none."""
    bare = F.regexp_replace(strip(c), r"(?i)^(?:(?:https?://)?(?:dx\.)?doi\.org/|doi:?\s*)", "")
    return F.when(bare.rlike(r"^10\.\d{4,}/\S+$"), bare)


def arxiv_id(c: Column | str) -> Column:
    """The first new- or old-style arXiv id with its version, null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)", 1), F.lit(""))


def first_year(c: Column | str) -> Column:
    """The first four-digit number between 1800 and 2100."""
    y = F.regexp_extract(c, r"(1[89]\d\d|20\d\d|2100)", 1)
    return F.nullif(y, F.lit("")).cast("int")


# The order in which kinds of identifiers are tried.
ID_TYPES = (
    ("doi", r"^10\.\d{4,}/"),
    ("arxiv", r"^\d{4}\.\d{4,5}(v\d+)?$|^[a-z-]+/\d{7}$"),
    ("pmid", r"^\d{1,9}$"),
    ("patent_number", r"(?i)^(us|ep|wo|cn|jp|kr|de|fr|gb)\s*\d"),
    ("rfc_number", r"(?i)^rfc\s*\d+$"),
    ("cve", r"(?i)^cve-\d{4}-\d+$"),
    ("celex", r"^\d[0-9]{4}[A-Z]\d+$"),
    ("iso_number", r"(?i)^iso"),
    ("isbn", r"^(97[89][\s-]*)?(\d[\s-]*){9}[\dXx]$"),
    ("case_cite", r"^\d+\s+[A-Z]\.\S*\s+\d+"),
    ("orcid", r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"),
)


def id_type(c: Column | str) -> Column:
    """The kind of an identifier; the first pattern that fits decides, null where none does."""
    return reduce(lambda rest, kv: F.when(F.trim(c).rlike(kv[1]), F.lit(kv[0])).otherwise(rest), reversed(ID_TYPES), F.lit(None).cast("string"))


def entity_id(kind: Column, value: Column) -> Column:
    """A stable id from the strongest identifier: 12 hex digits of a hash."""
    return F.concat(F.lit("ice:"), F.substring(F.sha2(F.concat(kind, F.lit(":"), value), 256), 1, 12))


# Venue abbreviations that stand for one venue; the first that a venue starts with counts.
VENUES = (
    ("j. mach. learn. res.", "journal of machine learning research"),
    ("nat.", "nature"),
    ("acm comput. surv.", "acm computing surveys"),
    ("knowl. inf. syst.", "knowledge and information systems"),
    ("psychol. bull.", "psychological bulletin"),
    ("proc. natl. acad. sci.", "proceedings of the national academy of sciences"),
    ("artif. intell.", "artificial intelligence"),
    ("j. artif. intell. res.", "journal of artificial intelligence research"),
    ("mach. learn.", "machine learning"),
    ("corr", "arxiv"),
    ("ieee trans. pattern anal. mach. intell.", "transactions on pattern analysis and machine intelligence"),
    ("ieee trans. knowl. data eng.", "transactions on knowledge and data engineering"),
    ("ieee trans. softw. eng.", "transactions on software engineering"),
    ("sci. rep.", "scientific reports"),
    ("inf. process. manag.", "information processing and management"),
    ("j. assoc. inf. sci. technol.", "journal of the association for information science and technology"),
    ("j. informetr.", "journal of informetrics"),
    ("account. res.", "accountability in research"),
    ("learn. publ.", "learned publishing"),
)


def venue_name(c: Column | str, table: tuple[tuple[str, str], ...] = VENUES) -> Column:
    """Venue in lower case, with a known abbreviation at its start written out."""
    full = lambda low: reduce(lambda rest, kv: F.when(low.startswith(kv[0]), F.lit(kv[1])).otherwise(rest), reversed(table), low)
    # a variable, or each abbreviation would bring the venue into its form again
    return F.get(F.transform(F.array(squeeze(F.lower(c))), full), F.lit(0))


def strip_latex(c: Column | str) -> Column:
    """Text of a LaTeX field: commands keep their argument, escapes their sign, braces and $ go."""
    kept = F.regexp_replace(c, r"\\(?:text\w*|emph|mathrm|mathit|mathbf)\{([^{}]*)\}", "$1")
    plain = F.regexp_replace(kept, r"\\([&%#_$])", "$1")
    return squeeze(F.regexp_replace(F.regexp_replace(plain, r"\\[a-zA-Z]+\s*", ""), r"[{}$]", ""))


def mask_citations(c: Column | str) -> Column:
    """Citation commands and bracketed numbers as one placeholder."""
    tex = F.regexp_replace(c, r"~?\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", " [CIT]")
    return squeeze(F.regexp_replace(tex, r"\[\d+(?:\s*[,;–-]\s*\d+)*\]", "[CIT]"))


#: what ends a sentence before a capital: a mark after a word of four letters, a number or a bracket, or ! and ?
SENTENCE_END = r"((?:[a-zA-Z0-9]{4}|[a-z]\)|[0-9]|[)\]])\.|[!?])\s+([A-Z\[])"


def sentences(c: Column | str, least: int = 1) -> Column:
    """Pieces between a period and a capital; short words before the period count as abbreviations."""
    cut = F.split(F.regexp_replace(c, SENTENCE_END, "$1\u0002$2"), "\u0002")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def without_asides(c: Column | str, depth: int = 4) -> Column:
    """Text without brackets that hold no citation mark, nested up to depth."""
    c = F.col(c) if isinstance(c, str) else c
    for _ in range(depth):
        c = F.regexp_replace(c, r"\s*\((?:[^()\[]|\[[^C])*\)", "")
    return squeeze(c)


def clip_words(c: Column | str, limit: int = 60) -> Column:
    """The first words of a text, with an ellipsis where any are left out."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.split(squeeze(c), " ")
    return F.when(F.size(words) <= limit, c).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" …")))


# Words that name nothing a search could look for.
SEARCH_STOP = (
    "the and for with that this from are was were which their its our all use used using we report reports follow following adopt same also than then they them has have had been but not can may more most other such both "
    "over under into across within between while when where each every any one two via per only well much many very upon about"
).split()


def search_terms(c: Column | str, most: int = 16) -> Column:
    """The terms of a citing sentence that narrow a search most: numbers, then capitalised words, then longer ones."""
    plain = F.regexp_replace(F.replace(mask_citations(c), F.lit("[CIT]"), F.lit(" ")), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{([^}]*)\})?", " $1 ")
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"([A-Za-z][A-Za-z0-9-]{2,}|[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda w: ~F.lower(w).isin(*SEARCH_STOP))
    low = F.transform(words, lambda w: F.lower(w))
    once = F.filter(F.transform(words, lambda w, i: F.struct(F.when(w.rlike("^[0-9]"), 0).otherwise(1).alias("n"), F.when(w.rlike("^[A-Z]"), 0).otherwise(1).alias("c"), (-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))), lambda x: F.array_position(low, F.lower(x.w)) == x.i + 1)
    return F.transform(F.slice(F.array_sort(once), 1, most), lambda x: x.w)

"""One form for texts that look the same but differ in their characters.

Look-alike characters are mapped with SQL `translate` and `regexp_replace`; the mapped
values are then grouped under an accent-sensitive Unicode collation, which also equates
composed and combining accents; each class gets its smallest text as canonical member.

Collation is dear on whole texts, so a hash comes first of what no accent, however it is
written, and no ignored character touches. Only texts that share it with a different text
are grouped under the collation; the others are alone in their class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut

# Letters of other scripts drawn like a Latin letter, in pairs.
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
}
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L"}
LATIN = {"ı": "i", "\u0251": "a", "\u0261": "g", "\u212a": "K", "\u212b": "Å", "\u037e": ";", "\u1fef": "`"}
LETTERS = GREEK | CYRILLIC | ARMENIAN | LATIN
#: full-width forms stand at a fixed distance from ASCII
WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"\uffe0": "¢", "\uffe1": "£", "\uffe5": "¥", "\uffe6": "\u20a9"}
#: kinds of space and of hyphen
SPACES = {c: " " for c in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"}
HYPHENS = {c: "-" for c in "\u2010\u2011\ufe63"}
#: joined letters
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "Ǉ": "LJ", "Ǌ": "NJ", "ǈ": "Lj", "ǋ": "Nj"}
#: characters that leave no mark on the page
UNSEEN = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E0FFF}]"
ONE_TO_ONE = LETTERS | WIDE | SPACES | HYPHENS
#: ranges that hold every character some mapping touches; texts without one are left as they are
TOUCHED = "[\\x{00A0}\\x{00AD}\\x{0131}-\\x{0133}\\x{01C4}-\\x{01CC}\\x{0251}\\x{0261}\\x{034F}-\\x{061C}\\x{115F}-\\x{1160}\\x{1680}\\x{17B4}-\\x{180F}\\x{1FEF}-\\x{206F}\\x{212A}\\x{212B}\\x{3000}\\x{3164}\\x{FB00}-\\x{FB06}\\x{FE00}-\\x{FE63}\\x{FEFF}-\\x{FFEF}\\x{E0000}-\\x{E0FFF}]"
#: ranges that hold the joined letters
LIGATURES = "[\\x{0132}\\x{0133}\\x{01C4}-\\x{01CC}\\x{FB00}-\\x{FB06}]"
SUSPECT = "[^\\x{0000}-\\x{007F}]"


def skeleton(text: Column) -> Column:
    """text with every look-alike replaced by the form it looks like; line breaks stay.

    Case, accents and punctuation stay as they are. Null gives null, '' gives ''.
    """
    source, target = "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values())
    assert len(source) == len(target)
    apart = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), JOINED.items(), text)
    whole = F.when(text.rlike(LIGATURES), apart).otherwise(text)
    return F.when(text.rlike(TOUCHED), F.translate(F.regexp_replace(whole, UNSEEN, ""), source, target)).otherwise(text)


#: what a collation may ignore or write in several ways: a letter with its accents, and control characters
LOOSE = "[\\x{0000}-\\x{007F}]?\\p{M}+|[^\\x{0000}-\\x{007F}]+"
CONTROL = "[\\x{0000}-\\x{0008}\\x{000E}-\\x{001F}\\x{007F}]+"


def firm(look: str) -> Column:
    """A hash of the characters of a skeleton that texts equal under the collation share."""
    c = F.col(look)
    plain = F.when(c.rlike("\\p{M}"), F.regexp_replace(c, LOOSE, "")).when(c.rlike(SUSPECT), F.regexp_replace(c, f"{SUSPECT}+", "")).otherwise(c)
    return F.xxhash64(F.when(c.rlike(CONTROL), F.regexp_replace(plain, CONTROL, "")).otherwise(plain))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(variant, class_key, members, canonical) of the distinct texts that look like another text.

    variant: 128-bit hash of the text. members: number of distinct texts that look like
    it, two or more. canonical: the smallest of them in code point order, whose hash is
    class_key. Exact copies are collapsed before the texts are grouped; null texts have no
    class.
    """
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    looks = text.select(variant("text").alias("variant"), skeleton(F.col("text")).alias("look"))
    hashed = cut(looks.select("variant", firm("look").alias("firm")))
    # classes by the firm characters with different texts; few rows
    firms = hashed.groupBy("firm").agg(F.min("variant").alias("low"), F.max("variant").alias("high")).where("low <> high").select("firm")
    mixed = cut(hashed.join(firms, "firm", "left_semi").select("variant").distinct())
    exact = text.withColumn("variant", variant("text")).join(mixed, "variant", "left_semi").groupBy("variant").agg(F.first("text").alias("text"))
    looked = cut(exact).withColumn("look", F.collate(skeleton(F.col("text")), "UNICODE"))
    canon = looked.groupBy("look").agg(F.min("text").alias("canonical"), F.count("*").alias("members")).where("members > 1")
    return looked.join(canon, "look").select("variant", variant("canonical").alias("class_key"), "members", "canonical")


def variant(text: str) -> Column:
    """A 128-bit hash of a text."""
    return F.unhex(F.md5(text))


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical): every document's text in its class's one form.

    Null texts keep null; empty texts stay empty.
    """
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    seen = classes(base, id_col, "text").select("variant", "canonical")
    return base.withColumn("variant", variant("text")).join(seen, "variant", "left").select(id_col, F.coalesce("canonical", "text").alias("canonical"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that look the same but differ in characters.

    Pairs are formed between the distinct texts of a class only; copies of one text come
    in when the pairs of texts are turned into pairs of documents, as the result asks.
    """
    members = cut(classes(docs, id_col, text_col).select("variant", "class_key"))
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), variant(text_col).alias("variant"))
    docs_of = hashed.join(members, "variant")
    a = docs_of.select("class_key", F.col("doc").alias("doc_a"), F.col("variant").alias("va"))
    b = docs_of.select("class_key", F.col("doc").alias("doc_b"), F.col("variant").alias("vb"))
    return a.join(b, "class_key").where("doc_a < doc_b AND va <> vb").select("doc_a", "doc_b")

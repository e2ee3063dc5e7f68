import pytest
from pyspark.sql import functions as F

from citeloom.llm import lookalike as L

SAME = ["Café file - ok", "Cafe\u0301 file - ok", "Ｃafé ﬁle - ok", "\u0421\u0430f\u00e9 file - ok", "Caf\u00e9\u00a0file\u2009\u2011\u202fok", "Ca\u200bf\u00e9 fi\u00adle - ok\ufeff"]
OTHER = ["café file - ok", "Cafe file - ok", "Café file – ok", "Café file - ok.", "Café  file - ok", "Café file\n- ok", "Café file - 0k"]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts, 1)], "doc_id long, text string, variant string, look string")


def test_pairs(spark, rows):
    got = rows(L.found(docs(spark, SAME + OTHER)))
    assert got == sorted([(a, b) for a in range(1, 7) for b in range(a + 1, 7)], key=repr)


@pytest.mark.parametrize("text", OTHER)
def test_visible_changes_differ(spark, text):
    assert L.found(docs(spark, [SAME[0], text])).count() == 0


def test_copies_and_nulls(spark, rows):
    d = docs(spark, ["a b", "a b", "a\u00a0b", None, "", "", None, "\u200b", "z" * 60_000 + "\u0430", "z" * 60_000 + "a"])
    assert rows(L.found(d)) == sorted([(1, 3), (2, 3), (5, 8), (6, 8), (9, 10)], key=repr)
    c = dict(rows(L.canonical_texts(d)))
    assert c[1] == c[2] == c[3] and c[4] is None and c[5] == c[8] and c[9] == c[10]
    assert L.found(d.limit(0)).count() == L.canonical_texts(d.limit(0)).count() == 0


def test_scripts(spark):
    pairs = [("\uac00\ub098", "\u1100\u1161\u1102\u1161"), ("\u304c", "\u304b\u3099"), ("\u0623", "\u0627\u0654"), ("\u0439", "\u0438\u0306"), ("\u212a", "K")]
    for a, b in pairs:
        df = spark.createDataFrame([(a, b)], "a string, b string")
        same = F.collate(L.skeleton(F.col("a")), "UNICODE") == F.collate(L.skeleton(F.col("b")), "UNICODE")
        assert df.select(same.alias("s")).first().s, (a, b)


def test_one_class_per_look(spark, rows):
    c = rows(L.classes(docs(spark, SAME + SAME + ["solo"])), "class_key", "members")
    assert {m for _, m in c} == {6} and len(c) == 6 and len({k for k, _ in c}) == 1


def test_firm_characters_outlast_the_collation(spark):
    """Texts equal under the collation have one hash of their firm characters."""
    pairs = [("\uac00\ub098", "\u1100\u1161\u1102\u1161"), ("caf\u00e9 x", "cafe\u0301 x"), ("a\u2260b", "a=\u0338b"), ("\u01d6z", "u\u0308\u0304z"), ("a\x07b", "ab"), (";", "\u037e"), ("n\u0303o", "\u00f1o"), ("a\u200bb", "ab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    look = df.select(*(L.skeleton(F.col(c)).alias(c) for c in "ab"))
    got = look.select((F.collate("a", "UNICODE") == F.collate("b", "UNICODE")).alias("equal"), (L.firm("a") == L.firm("b")).alias("firm")).collect()
    assert all(r.equal and r.firm for r in got)


def test_ranges_hold_every_mapped_character(spark):
    marks = [*L.ONE_TO_ONE, *L.JOINED, *(chr(c) for a, b in ((0xAD, 0xAD), (0x34F, 0x34F), (0x200B, 0x200F), (0xFE00, 0xFE0F), (0x180B, 0x180F), (0xE0000, 0xE0010)) for c in range(a, b + 1))]
    df = spark.createDataFrame([(c, c in L.JOINED) for c in marks], "c string, joined boolean")
    assert df.where(~F.col("c").rlike(L.TOUCHED) | (F.col("joined") != F.col("c").rlike(L.LIGATURES))).count() == 0

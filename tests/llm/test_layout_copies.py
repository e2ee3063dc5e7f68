import itertools

from citeloom.llm import layout_copies as L

A, T, V = "B. Kun, H. Nil", "Large trials: a study of things", "Arch. Soil Water"
FORMS = [
    f"{A} (2001). {T}. {V}, 4(2), 10--12. doi:10.1000/x.y", f"{A}. {T}. {V} 4(2):10-12, 2001. DOI 10.1000/x.y", f"{T}. {A}. {V}, 2001; 4(2): 10 - 12. https://doi.org/10.1000/x.y",
    f'2001. {A}, "{T.upper()}," {V} 4, 2, 10–12. 10.1000/X.Y', f"doi: 10.1000/x.y {A}: Large tri- als: a study  of things [2001] {V}; 4/2, 10-12",
]
OTHER = [
    f"{A} (2001). {T}. {V}, 2(4), 10--12. doi:10.1000/x.y", f"{A} (2001). Large trials: a things of study. {V}, 4(2), 10--12. doi:10.1000/x.y", f"{A} (2001). {T}. {V}, 4(2), 10--12.", f"{A} (2010). {T}. {V}, 4(2), 10--12. doi:10.1000/x.y",
    f"H. Nil, B. Kun (2001). {T}. {V}, 4(2), 10--12. doi:10.1000/x.y", f"{A} (2001). {T}. {V}, 4(2), 10--21. doi:10.1000/x.y",
]


def entries(spark, texts):
    return spark.createDataFrame([(k, t, k, "k") for k, t in enumerate(texts, 1)], "entry_id long, raw string, id long, key string")


def test_layouts_are_copies(spark, rows):
    got = rows(L.entry_copies(entries(spark, FORMS + OTHER)), "keep_id", "copy_id")
    assert got == [(1, k) for k in range(2, 6)]


def test_any_order_of_forms(spark, rows):
    for a, b in itertools.combinations(range(5), 2):
        assert rows(L.entry_copies(entries(spark, [FORMS[b], FORMS[a]])), "keep_id", "copy_id") == [(1, 2)], (a, b)


def test_equal_rows_and_nulls(spark, rows):
    odd = ["x", "x", None, "", " ", None, "", "y" * 100_000, "y" * 100_000, "X"]
    assert rows(L.entry_copies(entries(spark, odd)), "keep_id", "copy_id", "copies") == sorted([(1, 2, 2), (1, 10, 2), (8, 9, 1)], key=repr)
    assert L.entry_copies(entries(spark, odd).limit(0)).count() == 0


def test_references(spark, rows):
    data = [("A-B: c", "10.1/X"), ("ab c!", "https://doi.org/10.1/x"), ("a b c", None), ("A b c", ""), ("", None), (None, None), ("", None), ("a b c", "10.1/y"), ("--", None), ("--", None)]
    df = spark.createDataFrame([(k, t, d, "x") for k, (t, d) in enumerate(data, 1)], "ref_id long, title string, doi string, key string")
    assert rows(L.bib_copies(df), "keep_id", "copy_id") == [(1, 2), (3, 4)]
    assert L.bib_copies(df.limit(0)).count() == 0


def test_hot_group(spark, rows):
    df = spark.range(5000).selectExpr("id AS ref_id", "if(id % 3 = 0, 'same', concat('t', id)) AS title", "cast(NULL AS string) AS doi")
    got = rows(L.bib_copies(df), "keep_id", "copies")
    assert len(got) == 1666 and set(got) == {(0, 1666)}


def test_title_with_single_letters(spark, rows):
    pairs = [("E. coli growth under stress. Smith, J. Nature, 2001; 4(2): 1-9.", "Smith, J. (2001). E. coli growth under stress. Nature, 4(2), 1-9."), ("Vitamin C. A trial. Smith, J. Nature, 2001; 4(2): 1-9.", "Smith, J. (2001). Vitamin C. A trial. Nature, 4(2), 1-9.")]
    for pair in pairs:
        assert rows(L.entry_copies(entries(spark, list(pair))), "keep_id", "copy_id") == [(1, 2)]


def test_layouts_outside_the_five(spark, rows):
    more = [f"{A}. {T}. {V}. 2001;4(2):10-12. doi:10.1000/x.y", f"{A}: {T}, {V} 4:2 (2001) 10-12, doi 10.1000/x.y"]
    got = rows(L.entry_copies(entries(spark, FORMS + more)), "keep_id", "copy_id")
    assert got == [(1, k) for k in range(2, 8)]


def test_turned_into():
    pieces = ["ecoli", "growth", "smithj", "doea", "nature"]
    assert L.turned_into(pieces, "41", "smithjdoeaecoligrowthnature41") and L.turned_into(pieces, "41", "growthecolismithjdoeanature41")
    assert not L.turned_into(pieces, "41", "doeasmithjecoligrowthnature41") and not L.turned_into(pieces[:2], "41", "growthecoli41")
    assert L.joined(["a1", "", "2b", "3"]) == "a1|2b3"
    many = [f"p{k}x" for k in range(3000)]
    assert L.turned_into(many, "", "".join([*many[1500:2000], *many[:1500], *many[2000:]]))

from citeloom.operators import layout


def test_lines(spark, rows):
    w = spark.createDataFrame([("d", 1, 0, 0, 30.0, 5.0, 10.0, 8.0, "b"), ("d", 1, 0, 0, 10.0, 6.0, 12.0, 8.0, "a"), ("d", 1, 0, 0, 50.0, 5.0, 1.0, 8.0, " "), ("d", 1, 0, 1, 1.0, 20.0, 1.0, 1.0, "c")], "doc string, page int, block int, line int, x double, y double, w double, h double, word string")
    assert rows(layout.lines(w), "x0", "y0", "x1", "y1", "text") == [(1.0, 20.0, 2.0, 21.0, "c"), (10.0, 5.0, 40.0, 14.0, "a b")]


def test_running_heads(spark, rows):
    data = [("d", p, 1.0, 5.0, f"Page {p}", 100.0) for p in range(1, 5)] + [("d", p, 50.0, 55.0, "Page 1", 100.0) for p in (1, 2)] + [("d", 1, 2.0, 6.0, "Only here", 100.0)]
    df = spark.createDataFrame(data, "doc string, page int, y0 double, y1 double, text string, page_height double")
    assert rows(layout.without_running_heads(df), "page", "text") == [(1, "Only here"), (1, "Page 1"), (2, "Page 1")]


def test_reading_order(spark, rows):
    data = [("d", 1, 5.0, 95.0, 1.0, "title"), ("d", 1, 5.0, 45.0, 10.0, "l1"), ("d", 1, 55.0, 95.0, 9.0, "r1"), ("d", 1, 5.0, 45.0, 20.0, "l2"), ("d", 1, 5.0, 95.0, 90.0, "foot")]
    df = spark.createDataFrame([(*r[:5], 100.0, r[5]) for r in data], "doc string, page int, x0 double, x1 double, y0 double, page_width double, text string")
    assert [t for _, t in rows(layout.reading_order(df), "place", "text")] == ["title", "l1", "l2", "r1", "foot"]


def test_overlap(spark, rows):
    df = spark.createDataFrame([(1, 1, "f", 1, 6), (1, 2, "f", 4, 9), (1, 3, "f", 7, 12), (1, 4, "g", 1, 6), (2, 1, "f", 4, 9)], "q int, rank int, file string, line_start int, line_end int")
    assert rows(layout.without_overlap(df, "q"), "q", "rank") == [(1, 1), (1, 3), (1, 4), (2, 1)]

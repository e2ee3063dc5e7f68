import random

from citeloom.operators import evaluate, fusion, graph, references, retrieval


def signals(spark, data):
    return spark.createDataFrame(data, "ref_id long, seq int, signal_name string, fired boolean, confidence double")


def test_naive_bayes(spark, rows):
    s = signals(spark, [(1, 1, "phantom_doi", True, 1.0), (1, 2, "phantom_doi", False, 1.0), (2, 1, "no such", True, 1.0), (3, 1, "phantom_doi", True, 7.0)])
    got = rows(fusion.naive_bayes(s, fusion.definitions(spark)))
    assert got == [(1, 0.436047, "high", 1), (3, 0.436047, "high", 1)]
    assert fusion.naive_bayes(s.limit(0), fusion.definitions(spark)).count() == 0


def test_groups_count_once(spark, rows):
    s = signals(spark, [(1, 1, "phantom_doi", True, 1.0), (1, 2, "reference_not_found", True, 1.0), (1, 3, "chimera_detected", True, 1.0)])
    assert rows(fusion.grouped_bayes(s, fusion.definitions(spark)), "posterior") == [(0.436047,)]


def test_dempster_by_hand(spark, rows):
    s = signals(spark, [(1, 1, "phantom_doi", True, 0.5), (1, 2, "metadata_mismatch", False, 1.0)])
    m = (0.024, 0.776, 0.2)
    for p, l in ((0.48, 0.0), (0.0, 0.15)):
        t = 1 - p - l
        k = 1 - m[0] * l - m[1] * p
        m = ((m[0] * p + m[0] * t + m[2] * p) / k, (m[1] * l + m[1] * t + m[2] * l) / k, m[2] * t / k)
    assert rows(fusion.dempster_shafer(s, fusion.definitions(spark)), "posterior") == [(round(m[0] + m[2] / 2, 6),)]


def edges(spark, data):
    return spark.createDataFrame(data, "src long, dst long")


def test_components(spark, rows):
    chain = [(k, k + 1) for k in range(60)]
    random.Random(1).shuffle(chain)
    assert set(rows(graph.components(edges(spark, chain)), "component")) == {(0,)}
    assert rows(graph.components(edges(spark, [(1, 2), (3, 4), (4, 3), (5, 5), (None, 7)]))) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert graph.components(edges(spark, [])).count() == 0


def test_small_graphs(spark, rows):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (9, 9)])
    assert rows(graph.triangles(ring)) == [(1, 2, 3)]
    assert rows(graph.mutual(ring)) == [(1, 3, 1, 1)]
    full = edges(spark, [(a, b) for a in range(3) for b in range(3) if a != b])
    assert rows(graph.health(full), "density", "mutual_share") == [(1.0, 1.0)]
    assert rows(graph.densities(edges(spark, [(0, k) for k in range(1, 6)] + [(1, 2), (1, 2)]))) == [(0, 5, 2, 0.1)]


def test_quantiles_are_exact(spark, rows):
    r = random.Random(3)
    data = [(k % 2, float(r.choice([1, 2, r.random() * 100]))) for k in range(5000)]
    df = spark.createDataFrame(data, "g int, v double")
    want = sorted((g, q, sorted(v for h, v in data if h == g)[min(int(2500 * q), 2499)]) for g in (0, 1) for q in (0.0, 0.5, 0.95, 1.0))
    assert rows(evaluate.nearest_ranks(df, "g", "v", [0.0, 0.5, 0.95, 1.0])) == want


def test_similar_titles_against_all_pairs(spark, rows):
    r = random.Random(5)
    titles = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    sets = {t: set(t.split()) for t in titles if t}
    want = sorted(((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8), key=repr)
    assert rows(references.alike_titles(df, 0.8), "title_a", "title_b") == want


def test_budget(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("g", 1, 60.0), ("g", 2, 50.0), ("g", 3, 40.0), ("g", 4, None)], "g string, item long, s double")
    assert rows(references.budgeted(df.where("s IS NOT NULL"), [F.col("item")], "s", 100.0, "g")) == [("g", 1), ("g", 3)]


def test_bm25_prefers_the_rare_word(spark, rows):
    q = spark.createDataFrame([(1, "zebra common")], "query long, text string")
    u = spark.createDataFrame([(1, "common words"), (2, "zebra words"), (3, "common things"), (4, None), (5, "")], "unit long, text string")
    assert [r[1] for r in rows(retrieval.bm25(q, u, 2), "rank", "unit")] == [2, 1]


def test_greedy_lists(spark, rows):
    cols = "p string, id long, doi string, title string"
    a = spark.createDataFrame([("x", 1, "10.1/A", None), ("x", 2, None, "A long title here"), ("x", 3, None, "A long title here"), (None, 4, "10.1/a", None)], cols)
    b = spark.createDataFrame([("x", 7, "10.1/a", "z"), ("x", 8, None, "A long title herr"), ("y", 9, None, "A long title here")], cols)
    assert rows(references.greedy_matches(a, b, "p")) == [("x", 1, 7), ("x", 2, 8)]


def test_hyphens(spark, rows):
    t = spark.createDataFrame([(1, "a longi- tudinal co- operation of two- part"), (2, None)], "id long, text string")
    v = spark.createDataFrame([("longitudinal",)], "word string")
    assert rows(references.hyphen_breaks(t, v)) == [(1, "co", "operation", False), (1, "longi", "tudinal", True), (1, "two", "part", False)]


def test_reachable(spark, rows):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)])
    assert rows(graph.reachable(e, spark.createDataFrame([(1,)], "id long"))) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reachable(e, spark.createDataFrame([(1,)], "id long"), depth=1)) == [(1, 0), (2, 1)]


def test_auc_against_all_pairs(spark, rows):
    r = random.Random(6)
    data = [(round(r.random(), 2), r.random() < 0.4) for _ in range(300)]
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert rows(evaluate.auc(spark.createDataFrame(data, "p double, y boolean"), "p", "y", buckets=7), "auc") == [(round(want, 6),)]

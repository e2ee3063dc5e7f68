import itertools
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import anomaly as A
from citeloom.operators import claims as C
from citeloom.operators import verify as V


def found(spark, refs, works):
    a = spark.createDataFrame([(k, *r) for k, r in enumerate(refs, 1)], "ref_id long, title string, authors array<string>, year string")
    b = spark.createDataFrame([(100 + k, *w) for k, w in enumerate(works)], "work_id long, registry string, title string, authors array<string>, year string")
    return sorted((r.ref_id, r.registry, r.work_id) for r in V.search(a, b).collect())


def test_search(spark):
    works = [("p", "deep matching of open tables", ["Kun, B."], "2001"), ("p", "deep matching of open tables now", ["Kun, B."], "2001"), ("q", "deep matching of open graphs", ["H. Nil"], "2001"), ("q", "", None, None)]
    assert found(spark, [("Deep matching of open tables", ["B. Kün"], "2001")], works) == [(1, "p", 100)]
    # another author: a near title is not enough, an equal one is in a near year
    assert found(spark, [("Deep matching of open tables", ["Nil, H."], "2002")], works) == [(1, "p", 100), (1, "q", 102)]
    assert found(spark, [("Deep matching of open tables", ["Oth, H."], "2009")], works) == []
    assert found(spark, [("Deep matching of open tables", None, None)], works) == [(1, "p", 100), (1, "q", 102)]
    assert found(spark, [(None, None, None), ("...", [], "")], works) == found(spark, [], works) == found(spark, works[:0], []) == []


def every_pair(refs, works):
    """The search by comparing all pairs."""
    best = {}
    for (r, t, f, y), (w, g, u, h, z) in itertools.product(refs, works):
        a, b = set(t.split()), set(u.split())
        like = len(a & b) / len(a | b) if a and b else 0
        near = not y or not z or abs(int(y) - int(z)) < 2
        if like >= 0.6 and (not f or not h or f == h or (near and like >= 0.85)):
            best[r, g] = max(best.get((r, g), (0, 0)), (like, -w))
    return sorted((r, g, -w, round(like, 6)) for (r, g), (like, w) in best.items())


def titles(seed, words, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((1, 3, 5, 8, 9, 10, 14, 20)))] for _ in range(12)]

    def title():
        t = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 3))):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        return " ".join(t[: r.choice((20, 20, 20, 7))]) if r.random() < 0.97 else ""

    side = lambda *first: [(*first, title(), *r.choice(((None,), (["kun"],), (["kun"],), (["nil"],), (["oth"],))), r.choice((None, "2001", "2001", "2002", "2003", "2005"))) for _ in range(n)]
    refs, works = [(k, *x) for k, x in enumerate(side())], [(1000 + k, r.choice("pq"), *x) for k, x in enumerate(side())]
    return refs, works


@pytest.mark.parametrize(("seed", "words", "often", "longs"), [(1, 40, 2, 1), (2, 25, 4, 8), (3, 25, 64, 8), (4, 150, 2, 1), (5, 16, 3, 2)])
def test_search_against_all_pairs(spark, seed, words, often, longs):
    """Frequent and rare words, patterns with and without a bit for each word."""
    refs, works = titles(seed, words)
    a = spark.createDataFrame(refs, "ref_id long, title string, authors array<string>, year string")
    b = spark.createDataFrame(works, "work_id long, registry string, title string, authors array<string>, year string")
    assert sorted(tuple(x) for x in V.search(a, b, often, longs).collect()) == every_pair(refs, works)


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_search_forms_no_pairs_of_frequent_words(spark):
    """Titles that differ in one name only are not compared with one another: 1,200 x 1,200 pairs would be 1,440,000 rows."""
    a = spark.range(1200).selectExpr("id AS ref_id", "concat('overview of the name', id, ' shared task on ranking') AS title", "array(concat('a', id)) AS authors", "'2001' AS year")
    b = a.selectExpr("ref_id + 5000 AS work_id", "'p' AS registry", "title", "array(concat('b', ref_id)) AS authors", "year")
    before = shuffled(spark)
    hits = V.search(a, b).collect()
    assert len(hits) == 1200 and all(h.work_id == h.ref_id + 5000 for h in hits)
    assert shuffled(spark) - before < 200_000


def test_matches_are_read_not_made_again(spark):
    """What several aggregates read is a table, so its plan holds no join."""
    from citeloom.plans import verify_queries as Q

    assert "Join" not in Q.matches_of(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_matches_are_made_once(spark, monkeypatch):
    from citeloom.plans import verify_queries as Q

    made = []
    real = Q.matches_of
    monkeypatch.setattr(Q, "matches_of", lambda *x: made.append(1) or real(*x))
    Q.escalated(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_override(spark):
    df = spark.createDataFrame([("low", 0.01, 60.0), ("critical", 0.9, 60.0), ("low", 0.01, None), ("elevated", 0.1, 40.0)], "t string, p double, s double")
    tier, p = V.kill_shot(F.col("t"), F.col("p"), F.col("s"))
    legacy = V.kill_shot(F.col("t"), F.col("p"), F.col("s"), legacy=True)[0]
    assert [tuple(r) for r in df.select(tier, p, legacy).collect()] == [("high", 0.6, "HIGH"), ("critical", 0.9, "HIGH"), ("low", 0.01, "low"), ("elevated", 0.1, "elevated")]


def test_overall_status(spark, rows):
    cols = "ref_id long, registry string, by_id boolean, retracted boolean, title_status string, authors_status string, year_status string, venue_status string, confirmed boolean"
    m = spark.createDataFrame([(1, "a", False, False, "OK", "OK", "FAIL", None, True), (2, "a", True, False, "OK", "OK", "FAIL", None, True), (3, "a", False, False, "FAIL", "OK", "OK", "WARN", False), (4, "a", False, True, "OK", "OK", "OK", "OK", True)], cols)
    refs = spark.createDataFrame([(k,) for k in range(1, 6)], "ref_id long")
    assert rows(V.overall(refs, m), "ref_id", "status") == [(1, "WARN"), (2, "FAIL"), (3, "FAIL"), (4, "FAIL"), (5, "FAIL")]


def test_rings():
    ring = [(a, b) for a, b in itertools.combinations("abcd", 2)]
    assert A.grow_rings([*ring, ("d", "e"), ("x", "y")]) == [("a", "b", "c", "d")]
    assert A.grow_rings([("a", "b"), ("b", "c")]) == [] and A.grow_rings([]) == []
    r = random.Random(1)
    pairs = [p for p in itertools.combinations(range(14), 2) if r.random() < 0.5]
    near = {frozenset(p) for p in pairs}
    for group in A.grow_rings(pairs):
        assert all(frozenset(p) in near for p in itertools.combinations(group, 2)) and 3 <= len(group) <= 10


def test_rings_and_health(spark, rows):
    edges = spark.createDataFrame([(a, b) for a, b in itertools.permutations("abc", 2)] + [("c", "z")], "src string, dst string")
    nodes = spark.createDataFrame([(n, 2001 if n != "z" else 2009, [n]) for n in "abcz"], "id string, year int, authors array<string>")
    assert rows(A.rings(edges), "node") == [("a",), ("b",), ("c",)]
    every = A.all_anomalies(nodes, edges)
    assert rows(every) == [("self_citation_ring", "a", "critical", 1.0), ("temporal_anomaly", "c", "critical", 1.0)]
    assert rows(A.health(every)) == [(100.0, 80.0, 40.0, 100.0, 100.0, 83.0)]
    assert rows(A.health(every.limit(0))) == [(100.0,) * 6]
    fired = {r.signal_name: r.confidence for r in A.graph_signals(every).collect() if r.fired}
    assert fired == {"citation_ring_detected": 1.0, "temporal_anomaly": 1.0}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("t(28) = 2.20, p = .04", ("t", 28.0, 0.0, 2.2, 0.04, True, False)), ("F(2, 30) = 1.00, p < 0.01", ("F", 2.0, 30.0, 1.0, 0.01, False, True)), ("χ²(1) = 3.84, p = .050", ("chi2", 1.0, 0.0, 3.84, 0.05, True, False)),
        ("Z = -1.96, p = .05", ("Z", 0.0, 0.0, -1.96, 0.05, True, True)), ("r(20) = -.50, p = .018", ("r", 20.0, 0.0, -0.5, 0.018, True, False)),
    ],
)
def test_reported_tests(spark, text, want):
    got = C.check_tests(C.reported_tests(spark.createDataFrame([(1, f"We saw {text}. So.")], "id int, text string"), "id")).collect()
    assert [(r.test, r.df1, r.df2, r.statistic, round(r.p, 6), r.consistent, r.decision_error) for r in got] == [want]


def test_claims(spark, rows):
    t = spark.createDataFrame([(1, "It all began before. As shown in Kun, the method works on large tables [3,4]. The end is near and far (Kun et al., 2001)! Short [1]."), (2, None), (3, "")], "id int, text string")
    got = rows(C.claims(t, "id"), "cite_key", "claim", "before")
    assert got == [("3,4", "Kun, the method works on large tables.", "It all began before."), ("Kun et al., 2001", "The end is near and far!", "As shown in Kun, the method works on large tables [3,4].")]


def test_search_terms(spark):
    df = spark.createDataFrame([("We use the Resnet model with 512 units and small Batches \\cite{a} of small \\emph{glyphs} [3].",), (" ".join(f"word{k:02}x" for k in range(30)),), ("",)], "t string")
    a, b, c = (r[0] for r in df.select(X.search_terms("t")).collect())
    assert a == ["512", "Batches", "Resnet", "glyphs", "model", "units", "small"] and len(b) == 16 and c == []


def test_addresses(spark):
    df = spark.createDataFrame([("wang123@163.com",), ("a@city-hospital.com",), ("A.B@med.uni.ac.uk",), ("x@fastpublish.net",), ("nobody",), ("",), (None,)], "e string")
    assert [r[0] for r in df.select(C.email_risk("e")).collect()] == [35, 25, 0, 80, 0, 0, None]

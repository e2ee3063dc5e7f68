import itertools
import random

import numpy as np
import pytest

from citeloom.llm import entity_match as M


def damerau(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_against_full_table():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        most = r.randint(1, 4)
        assert M.distance(a, b, most) == min(damerau(a, b), most + 1), (a, b, most)


def frames(spark, refs, works):
    a = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(refs, 1)], "ref_id long, title string, year string, venue string, form string")
    b = spark.createDataFrame([(100 + k, *r, "x") for k, r in enumerate(works, 1)], "work_id long, title string, year string, venue string, side string")
    return a, b


W = [("Overview of the Drapigate shared task on ranking 2017", "2017", "Appl. Auth. Anal."), ("The Nelubrud survey: a robust study of peer reviews", "2015", None), ("Grilegegi: matching for protein assays, Part II", "2009", "TSD"), ("Image panels and coral reefs in the Krubro index", "2001", "")]


@pytest.mark.parametrize(
    ("typed", "works"),
    [
        (("overview on Drapigate sahred task on ranking 2017", "2016", "Applied Authorship Analysis"), [101]), (("Overview of the Drapigate shared task on ranking 2016", "2016", "Appl. Auth. Anal."), []), (("The Nelubrud survey", "2015", ""), [102]),
        (("Comment on: The Nelubrud survey: a robust study of peer reviews", "2015", ""), []), (("Grilegegi: matching for protein assays, Part I", "2009", "TSD"), []), (("GRILEGEGI - MATCHING FOR PROTEIN ASSAYS, PART II", None, None), [103]),
        (("Coral reefs and image panels in the Krubro index", "2001", ""), []), (("Image panels & coral reefs in Krubro index", "n.d.", ""), [104]), (("", "2001", ""), []), ((None, None, None), []), (("...", None, None), []), (("z" * 50_000, None, None), []),
    ],
)
def test_one_reference(spark, rows, typed, works):
    assert rows(M.found(*frames(spark, [typed], W))) == [(1, w) for w in works]


def test_several_registries_and_repeats(spark, rows):
    refs = [W[0], W[0]]
    works = [W[0], ("Overview of Drapigate shared task on ranking 2017", "2018", "AAA"), ("Overview of the Drapigate shared task on ranking 2018", "2018", "AAA")]
    assert rows(M.found(*frames(spark, refs, works))) == [(1, 101), (1, 102), (2, 101), (2, 102)]


def test_confidence_and_empty(spark):
    m = M.match(*frames(spark, [W[0]], W)).collect()
    assert [(r.work_id, r.confidence) for r in m] == [(101, 1.0)]
    a, b = frames(spark, [W[0]], W)
    assert M.found(a.limit(0), b).count() == M.found(a, b.limit(0)).count() == M.found(a.limit(0), b.limit(0)).count() == 0


def titles_of(spark, refs, works):
    rows = [(k, t, False) for k, t in enumerate(sorted(set(refs) - set(works)))] + [(10_000 + k, t, True) for k, t in enumerate(sorted(set(works)))]
    return spark.createDataFrame(rows, "t long, title string, in_works boolean"), {r[0]: r[1] for r in rows}


def slipped(rng, title, n, whole=True):
    """title with n slips at random places of its words, at most one in a word."""
    words = title.split()
    for k in rng.sample(range(len(words)), min(n, len(words))):
        w = words[k]
        i = rng.randrange(len(w))
        words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
    return " ".join(words)


@pytest.mark.parametrize("works", [30, 300, 1500])
def test_candidates_against_all_pairs(spark, works):
    """Of what the comparison accepts among all pairs, nearly all is found, at any size."""
    rng = random.Random(works)
    name = lambda: "".join(rng.choice(["ba", "ko", "tri", "ve", "su", "lim", "dra", "pon"]) for _ in range(rng.randint(3, 4)))
    frames_ = ["towards {a} ranking with {n}", "{n} {a} matching for protein assays", "does {a} improve coral reefs | evidence from {n} | a survey", "overview of the {n} shared task on {a}"]
    known = [rng.choice(frames_).format(n=name(), a=rng.choice(["robust", "adaptive", "calibrated", "incremental"])) for _ in range(works)]
    typed = [slipped(rng, rng.choice(known), n) for n in (1, 2, 3) for _ in range(60)] + [rng.choice(known).split(" | ")[0] for _ in range(20)]
    titles, text = titles_of(spark, typed, known)
    got = {(text[r.a], text[r.b]) for r in M.alike_titles(titles).collect()}
    parsed = {t: M.Title(t) for t in text.values()}
    want = {(a, b) for a in parsed for b in set(known) if M.title_likeness(parsed[a], parsed[b]) > 0}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100


def test_slips_in_the_rare_words(spark):
    """Three slips in the two rarest words of a title are no obstacle."""
    known = [f"towards common ranking {n}" for n in ("drapigate nelubrud", "grilegegi krubroso", "pondriko limvesu")]
    typed = [t.replace("drapigate nelubrud", "xrapigate nelubxrud").replace("grilegegi", "rgilegegi").replace("limvesu", "limves") for t in known]
    titles, text = titles_of(spark, typed, known)
    got = {(text[r.a], text[r.b]) for r in M.alike_titles(titles).collect()}
    assert set(zip(typed, known)) <= got


def test_window_is_whole_at_borders(spark, rows):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "ko", "tri", "ve", "su", "lim"]) for _ in range(4))
    known = [f"{word()} ranking with {word()}" for _ in range(120)]
    titles, _ = titles_of(spark, [slipped(rng, t, 1) for t in known], known)
    one = set(rows(M.neighbours(titles, parts=1), "a", "b"))
    many = set(rows(M.neighbours(titles, parts=9), "a", "b"))
    assert one <= many and len(one) > 80


def test_work_cited_under_many_forms(spark, rows):
    hot = "Overview of common words beside ranking"
    refs = [(hot, str(1900 + k % 120), f"Venue{'abcdefghij'[k % 10]} {'klmnopqrst'[k // 100]} {'uvwxyzabcd'[k // 10 % 10]}") for k in range(800)]
    works = [(hot, "2001", "Venue"), ("Overview of common words besides ranking", "2001", "Venue")]
    a, b = frames(spark, refs, works)
    each = M.typed_forms(a, b).selectExpr("*", "xxhash64(side, title, year, venue) AS form").cache()
    forms = [(r.form, M.Title(r.title), r.year, r.venue, r.side) for r in each.collect()]
    want = sorted((f[0], w[0]) for f in forms for w in forms if w[4] == 1 and f[0] != w[0] and M.confidence(f[1:4], w[1:4]) >= M.LEAST)
    assert len(want) > 400 and sorted(rows(M.form_pairs(each), "form", "other")) == want


def test_common_words_lose_nothing(spark, rows):
    pad = lambda k: "".join("bdfgklmnpr"[int(c)] + "a" for c in f"{k:03}")
    typed = "Towards xommon ranking {} measures of protein"
    works = [(f"Towards common ranking {pad(k)} measures of protein", "2001", "V") for k in range(500)]
    a, b = frames(spark, [("Towards common ranking zzzz measures of protein", "2001", "V"), (typed.format("yzzz"), "2001", "V")], [*works, ("Towards common ranking zzzz measures of protein", "2001", "V")])
    assert [w for r, w in rows(M.found(a, b))] == [100 + len(works) + 1] * 2


def test_best_assignment():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 5), (5, 2), (4, 4), (1, 6)] * 8:
        table = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.3), 3)
        big = np.zeros((max(n, m), max(n, m)))
        big[:n, :m] = table
        best = max(sum(big[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(len(big))))
        pairs = M.best_assignment(table)
        assert abs(sum(table[r, c] for r, c in pairs) - best) < 1e-9
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) and all(table[r, c] > 0 for r, c in pairs)


def test_one_entry_for_a_work(spark, rows):
    """In file f, form 2 takes the other work, for form 1 takes its first; elsewhere each is free."""
    wishes = [("f", 1, 10, 0.8), ("f", 1, 20, 0.79), ("f", 2, 10, 0.75), ("g", 2, 10, 0.75), ("g", 3, 30, 0.95), ("g", 4, 30, 0.9), ("h", 5, 10, 0.8), ("h", 6, 10, 0.73)]
    got = rows(M.assigned(spark.createDataFrame(wishes, "file string, form long, work long, confidence double")))
    assert got == sorted([("f", 1, 20), ("f", 2, 10), ("g", 2, 10), ("g", 3, 30), ("g", 4, 30), ("h", 5, 10)])


def test_registry_rows_of_one_work_form_a_chain(spark, rows):
    chain = [("Overview of common words beside ranking tables", "2001", "V"), ("Overview of common wordds besside rankking tables", "2001", "V"), ("Overviiew of common wordds besside rankking ttables", "2001", "V")]
    a, b = frames(spark, chain[:1], chain)
    assert rows(M.found(a, b)) == [(1, 101), (1, 102), (1, 103)]

import random

import numpy as np

from citeloom.llm import leakage as L


def brute(docs, items, n=L.STRETCH):
    grams = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in items if (w := L.words(t or ""))}
    out = set()
    for d, t in docs:
        w = L.words(t or "")
        have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, g in grams.items() if have & g}
    return out


def made(seed, n_items=60, n_docs=150):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([20, 120])]) for _ in range(n))
    items = [(k, text(r.randint(5, 40))) for k in range(n_items)] + [(900, None), (901, "")]
    docs = []
    for d in range(n_docs):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            w = L.words(items[r.randrange(n_items)][1])
            a, size = r.randint(0, 20), r.choice([9, 11, 12, 13, 30])
            t += " -- " + ", ".join(w[a : a + size]).upper() + ". " + text(r.randint(0, 40))
        docs.append((d, t))
    return docs, items


def test_search_loses_and_invents_nothing():
    for seed in range(4):
        docs, items = made(seed)
        index = L.Index(items)
        assert {(d, i) for d, t in docs for i in index.leaked(t)} == brute(docs, items)


def test_scores_against_all_items():
    docs, items = made(9)
    index = L.Index(items)
    for _, t in docs[:60]:
        terms = [w for w in set(L.words(t)[:30]) if w in index.number]
        if not terms:
            continue
        scores = [0.0] * len(index.ids)
        for w in terms:
            for at, x in index.postings[w]:
                scores[at] += x
        want = sorted(k for k, s in enumerate(scores) if s >= index.least[k])
        ids = np.array([[index.number[t] for t in terms] or [-1]])
        got = sorted(k for _, found in index.search(ids) for k in found)
        assert set(want) <= set(got) and all(scores[k] >= index.least[k] - 1e-6 for k in got)


def test_words():
    assert L.words("Ｔｈｅ　caf\u0065\u0301, so\u00adft \u0440\u0430\u0440er!") == ["the", "café", "soft", "paper"]
    assert L.words('{"a": "x\\u00e9\\ny"}') == ["a", "xé", "y"]


def test_frames(spark, rows):
    leak = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x {leak.title()} y", "q"), (2, None, "q"), (3, "", "q"), (4, leak[:-7], "q"), (5, "z " * 50_000 + leak.replace(" ", ",\n"), "q"), (6, leak, "q"), (6, leak, "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, leak, "e"), (2, leak + " more", "e"), (3, None, "e"), (4, "short", "e"), (None, leak, "e")], "item_id long, text string, doc_id string")
    assert rows(L.found(docs, items)) == [(d, i) for d in (1, 5, 6) for i in (1, 2)]
    assert L.found(docs.limit(0), items).count() == L.found(docs, items.limit(0)).count() == 0


def test_more_items_than_one_index_holds(spark, rows, monkeypatch):
    docs, items = made(2, 30, 40)
    monkeypatch.setattr(L, "INDEX_ITEMS", 7)
    got = L.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows(got)) == brute(docs, items)


def test_walk_over_ranges(monkeypatch):
    """Where a range holds several items, the walk finds what scoring each alone finds."""
    docs, items = made(3)
    items = [(100 * k + i, t) for k in range(4) for i, t in items]
    alone = L.Index(items)
    monkeypatch.setattr(L, "RANGES", 16)
    index = L.Index(items)
    assert index.width > 1 == alone.width
    assert [index.leaked(t) for _, t in docs] == [alone.leaked(t) for _, t in docs]
    assert {(d, i) for d, t in docs for i in index.leaked(t)} == brute(docs, items)

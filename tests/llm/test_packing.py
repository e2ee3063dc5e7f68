import random
from collections import defaultdict

import numpy as np

from citeloom.llm import packing as P


def packed(spark, sizes, capacities, **o):
    docs = spark.createDataFrame([(k, "x" * (n - 1), 0) for k, n in enumerate(sizes, 1)], "doc_id long, text string, length int")
    specs = spark.createDataFrame([(k, c, "x") for k, c in enumerate(capacities, 1)], "spec_id int, capacity long, doc_id string")
    return P.pack(docs, specs, **o).collect()


def check(out, sizes, capacities):
    used, pieces = defaultdict(int), defaultdict(list)
    for r in out:
        used[r.spec_id, r.container_id] += r.token_end - r.token_start
        pieces[r.spec_id, r.doc_id].append((r.token_start, r.token_end))
    for (s, _), n in used.items():
        assert n <= capacities[s - 1]
    for s, c in enumerate(capacities, 1):
        for k, n in enumerate(sizes, 1):
            p = sorted(pieces[s, k])
            assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:]))
            assert len(p) == -(-n // c)
    return {s: sum(k[0] == s for k in used) for s in range(1, len(capacities) + 1)}


def test_pack(spark):
    r = random.Random(3)
    sizes = [min(5000, int(r.paretovariate(1.1) * 20)) for _ in range(1500)] + [100, 101, 200, 1000, 1]
    n = check(packed(spark, sizes, [100, 1000], shard=400), sizes, [100, 1000])
    for s, c in ((1, 100), (2, 1000)):
        assert n[s] * c * 0.85 <= sum(sizes)


def test_best_filling_against_all_choices():
    r = random.Random(1)
    for _ in range(60):
        sizes, left, c = sorted(r.sample(range(5, 40), 3)), [r.randint(0, 3) for _ in range(3)], r.randint(30, 90)
        got = P.best_filling(sizes, left, c, 1)
        best = max(x for a in range(left[0] + 1) for b in range(left[1] + 1) for d in range(left[2] + 1) if (x := a * sizes[0] + b * sizes[1] + d * sizes[2]) <= c)
        assert sum(n * s for n, s in zip(got, sizes)) == best and all(n <= m for n, m in zip(got, left))


def test_configurations_meet_the_demand():
    for filling, _ in (out := P.configurations([40, 55, 70], [17, 5, 9], 100)):
        assert filling[0] * 40 + filling[1] * 55 + filling[2] * 70 <= 100
    assert [sum(f[k] * t for f, t in out) for k in range(3)] == [17, 5, 9]


def test_groups_have_like_counts():
    g = P.group_sizes(np.arange(100), np.ones(100), 4)
    assert np.bincount(g).tolist() == [25] * 4 and (np.diff(g) >= 0).all()


def test_oversized_and_nulls(spark, rows):
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "äöü"), (5, "abcdefgh"), (6, "abcdefgh")], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 6), (2, 100), (None, 5), (4, None), (5, 0)], "spec_id int, capacity long")
    p = P.pack(docs, specs)
    assert rows(P.oversized(p)) == [(1, 4), (1, 5), (1, 6)]
    assert {r[0] for r in rows(p.where("spec_id = 2"), "doc_id")} == {1, 3, 4, 5, 6}
    assert P.pack(docs.limit(0), specs).count() == P.pack(docs, specs.limit(0)).count() == 0
    assert [r[0] for r in rows(P.fill_report(p, specs), "spec_id")] == [1, 2]

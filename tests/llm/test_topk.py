import math
import random

import numpy as np

from meltemi.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 5 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q)[:k]
            out |= {(q, r + 1, c, -x) for r, (x, c) in enumerate(s)}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int").repartition(3)
    got = [tuple(r) for r in topk.searched(df, "vec_id % 5 = 0", k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 7)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 2)
    rnd = random.Random(6)
    f = lambda x: round(x * 64) / 64
    rows = [(i, [f(rnd.gauss(0, 1)) for _ in range(10)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)] + [(i, [0.0] * 10) for i in range(190, 200)]
    rows += [(201, None), (205, [1.0, None] * 5), (210, [float("nan")] * 10), (215, [float("inf")] * 10), (None, rows[0][1])]
    assert run(spark, rows) == brute(rows, 5)


def test_few_negative_and_no_vectors(spark):
    rows = [(0, [1.0, -2.0]), (5, [-1.0, 2.0]), (7, [-3.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0])]) == set()


def test_ids_in_several_rows(spark):
    """Each row is a candidate, each different vector of a query's id a query; equal rows ask once."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (3, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows + rows[:1]], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score // 65536) for r in topk.searched(df, "vec_id = 0", 3).collect())
    assert got == sorted([(0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 3, 1), (0, 1, 3, 3), (0, 2, 1, 1), (0, 3, 1, 1)])


def test_the_cutoff_spares_most_pairs():
    """Phase three resolves a small part of all pairs, and none of the true best is missing from it."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(20, 64))
    v = np.floor(256 * (centres[rnd.integers(0, 20, 3000)] + 0.3 * rnd.normal(size=(3000, 64)))).astype(np.int64)
    ids, q = np.arange(3000), np.arange(0, 3000, 50)
    cut = topk.cutoffs(q, v[q], ids[:800], v[:800], 5)
    a, b = topk.sufficient(q, v[q], ids, v, cut)
    assert len(a) < 0.15 * len(q) * len(ids)
    s = (v[q] @ v.T).astype(float)
    s[np.arange(len(q)), q] = topk.NONE
    left = set(zip(a.tolist(), b.tolist()))
    for i in range(len(q)):
        assert all((i, j) in left for j in np.argsort(-s[i])[:5].tolist()) and cut[i] <= np.sort(s[i])[-5]


def test_numbers_beyond_floating_point_and_uneven_lengths(spark):
    rows = [(0, [3e6, -2e6, 1.0]), (5, [1e6]), (6, [3e6, -2e6]), (7, [2.9e6, -2e6, 5.0]), (8, [])]
    assert run(spark, [(i, v + [0.0] * (3 - len(v))) for i, v in rows]) == brute([(i, v + [0.0] * (3 - len(v))) for i, v in rows], 5)
    assert {x[:3] for x in run(spark, rows)} == {x[:3] for x in brute([(i, v + [0.0] * (3 - len(v))) for i, v in rows], 5)}

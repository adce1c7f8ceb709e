import math
import random
import re
from collections import defaultdict

import numpy as np

from meltemi.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, [3, 1, 2] * len(order)))
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not above:
            target.update({s: level * w[s] for s in free})
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["a", "b", "é", "Z", "", None] + ["hot"] * 4)
        out.append((i, rnd.choice([None, ""] + [" ".join("w" * rnd.randint(1, 90))] * 9 + ["x\t" * 700]), "l", source, 5))
    return out


def test_mix(spark):
    rows = corpus(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, rate string, source string, size long")
    got = {r.doc_id: r for r in mixing.mixed(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mixed(df.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()} and len(got) == 900
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for i, _, _, s, _ in rows:
        total[s] += size[i]
        taken[s] += got[i].taken
    want = brute_targets(total)
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and math.isclose(r.target, want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 2 for s in total)
    # Rates are the tilted ones: log rate over size is one number per source wherever the cap doesn't bind.
    for s in total:
        lam = [math.log(got[i].rate) / size[i] for i, _, _, x, _ in rows if x == s and size[i] and got[i].rate < 2 - 1e-9]
        assert not lam or np.ptp(lam) < 1e-9


def test_targets_match_brute_force(spark):
    rnd = random.Random(5)
    for n in (1, 2, 3, 7, 12):
        sizes = {f"s{i}" if i else None: rnd.choice([0, 1, 5, 1000, rnd.randint(1, 99)]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want), (sizes, got, want)


def test_degenerate_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mixed(spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", None)], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 3
    rows = mixing.mixed(spark.createDataFrame([(7, "a b", "s")] * 4, schema)).collect()
    assert sorted(r.taken for r in rows) == [2, 2, 4, 4]


def test_rates_meet_targets_to_the_tolerance(spark):
    """Sources at their stop, just below it, far below their size, and with one very large document."""
    cells = [("stop", 3, 10), ("stop", 50, 2), ("near", 2, 30), ("near", 400, 1), ("low", 1, 5), ("low", 900, 9), (None, 7, 1000), (None, 100_000, 1)]
    size = {}
    for s, x, n in cells:
        size[s] = size.get(s, 0) + x * n
    goal = {"stop": 2.0 * size["stop"], "near": 1.999999 * size["near"], "low": 0.01 * size["low"], None: 1.3 * size[None]}
    c = spark.createDataFrame(cells, "source string, size long, n long")
    g = spark.createDataFrame([(s, size[s], t) for s, t in goal.items()], "source string, source_size long, target double")
    lam = {r.source: r.lam for r in mixing.solved(c, g).collect()}
    assert lam.keys() == goal.keys()
    for s, t in goal.items():
        got = sum(n * x * min(2.0, math.exp(lam[s] * x)) for k, x, n in cells if k == s)
        assert math.isclose(got, t, rel_tol=1e-8)


def test_what_rounding_leaves_is_below_any_document_with_room():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        size = np.unique(rnd.integers(1, 300, rnd.integers(1, 12)))[::-1]
        n = rnd.integers(1, 5, len(size))
        rate = np.minimum(2.0, np.exp(rnd.normal(0, 0.02) * size))
        k = mixing.rounded_sizes(size, n, rate)
        left = float((n * rate * size).sum() - (k * size).sum())
        room = size[k < 2 * n] if left > 0 else size[k > 0]
        assert (k >= 0).all() and (k <= 2 * n).all() and (not len(room) or abs(left) < room.min() + 1e-6)

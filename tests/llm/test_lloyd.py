import hashlib
import math
import random

import pytest

from meltemi.llm import lloyd


def brute(rows, k, rounds, dims, scale, seed):
    """The same vector by vector."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [assign(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *assign(v)[::-1]) for i, v in kept]
    per = {c: sum(d for _, o, d in out if o == c) for c in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out), key=str)


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 1, "x", 5, 6) for i, v in rows], f"vec_id long, embedding {kind}, n int, key string, v int, cluster int").repartition(4)


def corpus(dims):
    rnd = random.Random(13)
    make = lambda: [rnd.randint(-64, 64) / 32 for _ in range(dims)]
    hot = make()
    rows = [(i, hot if i % 3 == 0 else make()) for i in range(200)] + [(7, make()), (7, make()), (8, hot), (None, make()), (None, hot)]
    bad = [None, [], make()[1:], make() + [0.0], [None] + make()[1:], [float("nan")] + make()[1:], [float("inf")] + make()[1:], [float("-inf")] + make()[1:]]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("dims,k,rounds", [(4, 8, 10), (3, 2, 0), (2, 5, 3)])
def test_vector_by_vector(spark, dims, k, rounds):
    rows = corpus(dims)
    got = lloyd.clustered(table(spark, rows), k, rounds, dims, 1024, 3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, rounds, dims, 1024, 3)


def test_doubles_ties_and_empty_clusters(spark):
    """Equal first centroids: the second one never gets a vector and stays."""
    rows = [(i, [0.5, -0.25]) for i in range(6)] + [(i, [x / 3, -x / 7]) for i, x in enumerate(range(6, 30), 6)]
    got = lloyd.clustered(table(spark, rows, "array<double>"), 12, 4, 2, 100, 3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 12, 4, 2, 100, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -4.0])]
    assert sorted(map(tuple, lloyd.clustered(table(spark, rows), 8, 10, 2).collect()), key=str) == brute(rows, 8, 10, 2, 1024, 3)
    assert lloyd.clustered(table(spark, [(1, None)]), 8, 10, 2).count() == 0
    assert lloyd.clustered(table(spark, rows).limit(0), 8, 10, 2).count() == 0


def test_a_component_that_leaves_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="lies beyond"):
        lloyd.clustered(table(spark, [(1, [1e9, 0.0])]), 8, 10, 2).collect()

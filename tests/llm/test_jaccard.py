import random
import re

import numpy as np
import pytest

from meltemi.llm import jaccard
from meltemi.llm.components import components
from meltemi.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, num=90, den=100):
    sets = {i: grams(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(n, seed, families=12):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 60))
    bases = [[word() for _ in range(rnd.choice([2, 3, 8, 14, 25, 60, 140, 300]))] for _ in range(families)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE\x0btwo", "é É"]
    while len(texts) < n:
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.3:
            w += [word() for _ in range(rnd.randint(1, 4))]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    return list(enumerate(texts))


def test_sets_match_brute_force():
    texts = [t or "" for _, t in corpus(200, 3)] + ["x " * 90_000 + "y"]
    h, n = shingle_sets([t.encode() for t in texts])
    assert n.tolist() == [len(grams(t)) for t in texts]
    at = np.cumsum(n)
    same = {}
    for t, a, c in zip(texts, at, n):
        assert same.setdefault(frozenset(grams(t)), h[a - c : a].tobytes()) == h[a - c : a].tobytes()
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (55, 100)])
def test_similar_sets_share_a_signature(num, den):
    rnd = np.random.default_rng(7)
    bands = jaccard.Bands(num, den)
    for _ in range(300):
        size = int(rnd.integers(1, 80))
        a = rnd.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate([a[: size - int(rnd.integers(0, size // 8 + 2))], rnd.integers(0, 2**63, int(rnd.integers(0, size // 8 + 2)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if not both or den * both < num * (len(a) + len(b) - both):
            continue
        s, owner = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
        assert set(s[owner == 0]) & set(s[owner == 1])


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_components(spark, monkeypatch, chunk):
    import meltemi.llm.components as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in edges:
            if u != v:
                comp[u] = comp[v] = min(comp[u], comp[v])
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect())) == comp


@pytest.mark.parametrize("block", [512, 8])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", block)
    monkeypatch.setattr(jaccard, "PIECE", 40 * block)
    rows = corpus(260, block)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, family string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(df).collect()}
    assert got == brute(rows)


def test_degenerate_tables(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None)]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 3), (3, 2, 3), (3, 2, 3)]


def test_repeated_ids_are_texts_of_their_own(spark):
    rnd = random.Random(9)
    text = lambda: [f"w{rnd.randint(0, 9999)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = [*b[:-1], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, " ".join(near)), (4, " ".join(c)), (4, " ".join(c))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, 58, 1), (1, 58, 1), (3, 58, 1), (4, 58, 4), (4, 58, 4)]
    one = jaccard.linked(spark.createDataFrame([*rows[:2], (0, " ".join(a))], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in one.collect()) == [(0, 0), (1, 0), (1, 1)]


def test_cuts_of_sets_with_many_elements_and_few_parts():
    """Long sets at 0.8: few need a further cut, and signatures stay near one for each allowed difference and band."""
    rnd, bands = np.random.default_rng(1), jaccard.Bands(80, 100)
    n = np.array([300] * 50)
    s, owner = jaccard.signatures(rnd.integers(0, 2**63, n.sum(), dtype=np.uint64), n, bands)
    allowed = sum(int(bands.differences(bands.of(n) + up)[0]) for up in (0, 1))
    assert len(s) < 1.3 * len(n) * allowed

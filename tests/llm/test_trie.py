import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meltemi.llm import packing, shingles, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
B = "<s>"


def toks(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def grams(t):
    t = toks(t)
    return list(zip([B, B, *t], [B, *t], t))


def brute(rows):
    """The model by plain counting: contexts of more than HOT occurrences, and those before a first word, spread their mass otherwise."""
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    count = {k: Counter(g[3 - k :] for t in train for g in grams(t)) for k in (2, 3)}
    total, known = defaultdict(Counter), defaultdict(Counter)
    for k in (2, 3):
        for g, m in count[k].items():
            total[k][g[:-1]] += m
            known[k][g[:-1]] += 1

    def slot(ctx):
        h = [np.array([trie.BEGIN]) if w == B else shingles.words([w.encode()])[0] for w in ctx]
        one = trie.context(h[0])
        return int((one if len(h) == 1 else trie.followed(one >> np.uint64(24), h[1] & trie.LOW))[0] % np.uint64(trie.SLOTS))

    # A context in the same place of the table as a dealt one is dealt as well.
    slots = {ctx: slot(ctx) for k in (2, 3) for ctx in total[k]}
    dealt = {k: {slots[ctx] for ctx, m in total[k].items() if m > trie.HOT or set(ctx) == {B}} for k in (2, 3)}

    def p(g):
        if len(g) == 1:
            return p1(g[0])
        k, ctx = len(g), g[:-1]
        m, low = total[k][ctx], p(g[1:])
        if not m:
            return low
        if slots[ctx] in dealt[k]:
            b = trie.MASS[k] / (m + trie.MASS[k])
            return (1 - b) * count[k][g] / m + b * low
        return max(0, count[k][g] - trie.DISCOUNT[k]) / m + trie.DISCOUNT[k] * known[k][ctx] / m * low

    words = [*c, "unseen"]
    for ctx in list(total[3])[:5]:
        # All words and one unseen: the add-one model gives its share to each of these.
        assert math.isclose(sum(p((*ctx, w)) for w in words), 1.0, rel_tol=1e-9)
    out = {}
    for i, t in rows:
        g = grams(t)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(g), sum(c[x[-1]] > 0 for x in g), n, sum(math.log10(p1(x[-1])) for x in g), sum(math.log10(p(x)) for x in g))
    return out


def corpus(n=400):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["The", "the", "of", "é", "x1", "ß"] + [f"w{rnd.randint(0, 40)}"] * 3 + [f"r{rnd.randint(0, 10**6)}"])
    return [(i, rnd.choice([None, "", "\t"]) if i % 29 == 0 else rnd.choice([" ", "\n"]).join(word() for _ in range(rnd.randint(1, 80)))) for i in range(n)]


def agrees(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and math.isclose(got[i][4], w[4], rel_tol=1e-9)
        # Each of the two levels rounds by half a step at most.
        assert abs(got[i][5] - w[5]) <= w[1] * 1.001 / trie.STEPS + 1e-9, (got[i], w)


@pytest.mark.parametrize("hot", [1 << 17, 30])
def test_scores_match_brute_force(spark, monkeypatch, hot):
    """Also with many shards, short runs that end within texts, and common contexts dealt over shards."""
    if hot == 30:
        monkeypatch.setattr(trie, "SHARD_BYTES", 2000)
        monkeypatch.setattr(trie, "SALT", 3)
        monkeypatch.setattr(trie, "RUN_TOKENS", 57)
    monkeypatch.setattr(trie, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, uid int, train string").repartition(4)
    agrees({r.doc_id: tuple(r)[1:] for r in trie.scored(df).collect()}, brute(rows))


def test_elias_fano(tmp_path):
    rnd = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (300, 400), (300, 2**62), (2000, 2**40), (50, 60), (5000, 2**50)):
        a = np.unique(rnd.integers(0, top, n, dtype=np.uint64))
        shape, arrays = trie.EliasFano.parts(a)
        e = trie.EliasFano(*shape, *arrays)
        assert np.array_equal(e.get(np.arange(len(a))), a) and np.array_equal(e.find(a), np.arange(len(a)))
        q = rnd.integers(0, 2 * top, 500, dtype=np.uint64)
        at = np.searchsorted(a, q)
        want = np.where((at < len(a)) & (np.append(a, 0)[np.minimum(at, len(a))] == q), at, -1)
        assert np.array_equal(e.find(q), want)
        # A few bits a number beyond the logarithm of their mean distance.
        if n >= 2000:
            assert sum(x.nbytes for x in arrays) * 8 < len(a) * (math.log2(top / len(a)) + 4)


def test_trie_mapped_from_a_file(tmp_path):
    rnd = np.random.default_rng(5)
    ctx = np.unique(rnd.integers(0, 2**40, 300, dtype=np.uint64))
    key = np.unique((rnd.integers(0, len(ctx), 4000, dtype=np.uint64) << trie.WIDTH) | rnd.integers(0, 2000, 4000, dtype=np.uint64))
    owner, word = (key >> trie.WIDTH).astype(np.int64), key & trie.LOW
    f, b = rnd.random(len(key)) ** 4 + 1e-6, rnd.random(len(ctx)) + 1e-3
    path = tmp_path / "shard.trie"
    path.write_bytes(b"".join(trie.Trie.laid_out(ctx, b, owner, word, f)))
    t = trie.Trie(np.memmap(path, np.uint8, "r"))
    i, code = t.of(np.append(ctx, np.uint64(7)))
    assert np.array_equal(i[:-1], np.arange(len(ctx))) and i[-1] == -1 and code[-1] == 0
    assert np.allclose(trie.valued(code[:-1]), b, rtol=10 ** (0.51 / trie.STEPS) - 1)
    assert np.allclose(trie.valued(t.codes(owner, word)), f, rtol=10 ** (0.51 / trie.STEPS) - 1)
    assert (t.codes(owner, word + np.uint64(5000)) == trie.ABSENT).all()


def test_packing():
    arrays = [np.arange(9, dtype=np.uint64) << np.uint64(33), np.zeros(0, np.uint16), np.array([255], np.uint8)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, packing.unpacked(packing.packed(*arrays))))


def test_degenerate_tables(spark):
    assert trie.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a a a"), (1, "a a a"), (None, None), (2, "x" * 100_000)]
    got = trie.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [1, 2, 4, 4]
    held = trie.scored(spark.createDataFrame(rows[:2], "doc_id long, text string"), held_out="true").collect()
    assert [(r.train_tokens, r.n_known, r.held_out) for r in held] == [(0, 0, True)] * 2 and all(r.score == r.base_score for r in held)


def test_very_long_texts_go_through_in_stretches(monkeypatch):
    monkeypatch.setattr(trie.shingles, "RUN", 1000)
    texts = [b"a b", b" ".join(b"w%d" % k for k in range(5000)), b"", b"y" * 3000 + b" z"]
    runs = list(trie.token_runs(texts, 300))
    assert all(len(h) <= 300 + 1 for h, *_ in runs)
    whole = [trie.END if w is None else None for t in texts for w in toks(t.decode())]
    h, d = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    assert len(h) == len(whole) and [x == trie.END for x in h] == [w is not None for w in whole]
    assert d.tolist() == [i for i, t in enumerate(texts) for _ in toks(t.decode())]
    for before, after in zip(runs, runs[1:]):
        assert before[4] == after[3]
        if after[3]:
            assert np.array_equal(np.array(after[2]), np.concatenate([np.array(before[2]), before[0]])[-2:])


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_ascending_keys_meet_decoded_stretches(monkeypatch, n):
    rng = np.random.default_rng(n)
    a = np.unique(np.concatenate([rng.integers(1 << 40, 1 << 62, n, dtype=np.uint64), np.arange(n, dtype=np.uint64) + np.uint64(1 << 41)]))
    shape, parts = trie.EliasFano.parts(a)
    seq = trie.EliasFano(*shape, *parts)
    key = np.unique(np.concatenate([a[rng.random(len(a)) < 0.5], rng.integers(0, 1 << 63, n, dtype=np.uint64), a[:1], a[-1:] + np.uint64(1)]))
    want = np.where(np.isin(key, a), np.searchsorted(a, key), -1)
    for stretch in (1 << 18, 7):
        monkeypatch.setattr(trie, "STRETCH", stretch)
        assert (seq.merged(key) == want).all() and (seq.values(0, len(a)) == a).all()
        assert (seq.values(len(a) // 3, len(a) // 2) == a[len(a) // 3 : len(a) // 2]).all()
    shuffled = rng.permutation(np.concatenate([key, key]))
    assert (seq.find(shuffled) == want[np.searchsorted(key, shuffled)]).all()

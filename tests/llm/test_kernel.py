import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from meltemi.llm import kernel


def corpus(n, seed=5):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = [rnd.choice(["the", "of", "and"] + [f"w{rnd.randint(0, 999)}"] * 3) for _ in range(rnd.randint(5, 200))]
        text = " ".join(words) if good else " ".join(w + "###" for w in words[:3]) * rnd.randint(3, 30)
        docs.append((i, text, "x", "y"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_isotonic_matches_brute_force():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        y, w = rnd.random(7), rnd.integers(1, 5, 7).astype(float)
        # min-max formula of isotonic regression
        best = [max(min((y[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum() for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        assert np.allclose(kernel.isotonic(y, w), best)


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, f string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = kernel.scored(d, lab).collect()
    truth = {i: q for i, q, _ in labels}
    out = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 100 < len(out) < 300
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_normal_equations_match_the_whole_matrix(spark):
    rnd = np.random.default_rng(1)
    f = rnd.random((200, kernel.N_STATISTICS))
    y = (f[:, 0] > 0.5).astype(float)
    train = spark.createDataFrame([(list(map(float, a)), float(b), i % kernel.FOLDS) for i, (a, b) in enumerate(zip(f, y))], "f array<double>, y double, fold int").repartition(5)
    m = kernel.fit(train, width=16)
    x = m.features(f)
    assert np.allclose(m.parts[-1], np.linalg.solve(x.T @ x + 1e-3 * 200 * np.eye(17), x.T @ y))


def test_nulls_empty_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x" * 300_000)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    rows = kernel.scored(d, lab).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert kernel.scored(d.limit(0), lab).count() == 0
    one = spark.createDataFrame([(2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in kernel.scored(d, one, held_out="doc_id = 9").collect()} == {1.0}


def test_accepted_keeps_whole_rows(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in kernel.accepted(d, lab).collect()}
    good = {i for i, q, _ in labels if q}
    assert got <= set(docs) and len({r[0] for r in got} ^ good) < 15


def brute_statistics(text):
    b, words = text.encode(), text.split()
    size, m = max(1, len(b)), max(1, len(words))
    part = lambda ok: sum(map(ok, b)) / size
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(words)),
        min(20.0, sum(x not in b" \t\n\x0b\x0c\r" for x in b) / m),
        part(lambda x: 65 <= x <= 90),
        part(lambda x: 48 <= x <= 57),
        part(lambda x: x in b"#*$%&|<>"),
        part(lambda x: x in b"!?.,;:"),
        part(lambda x: x == 33),
        part(lambda x: x > 127),
        len(set(words)) / m,
        len(set(zip(words, words[1:]))) / m,
        max(map(words.count, words)) / m if words else 0.0,
        len(set(lines)) / max(1, len(lines)),
        sum(w in kernel.STOP_WORDS for w in words) / m,
        len(zlib.compress(b, 1)) / size,
    ]


def test_query_matches_brute_force(spark):
    """The whole query by dense matrices: statistics, features, ridge by fold, isotonic values, scores of all rows."""
    docs, labels = corpus(260, seed=8)
    docs = [(i, t) for i, t, *_ in docs] + [(900, None), (901, ""), (902, "x " * 4000)]
    truth = {i: q for i, q, _ in labels} | {901: 0}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    got = {r.doc_id: (r.held_out, r.score) for r in kernel.scored(d, lab).collect()}
    fold = {r.doc_id: r.k for r in lab.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(kernel.FOLDS)).alias("k")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    f = {i: np.array(brute_statistics(t or "")) for i, t in docs}
    ids = [i for i, _ in docs if i in truth and not held(i)]
    x, y, k = np.array([f[i] for i in ids]), np.array([truth[i] for i in ids], float), np.array([fold[i] for i in ids])
    rnd = np.random.default_rng(7)
    omega, phase = rnd.normal(size=(14, 128)) / 4.0, rnd.uniform(0, 2 * np.pi, 128)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    feature = lambda a: np.hstack([np.sqrt(2 / 128) * np.cos(np.clip((a - mean) / scale, -6, 6) @ omega + phase), np.ones((len(a), 1))])
    z = feature(x)
    ridge = lambda m: np.linalg.solve(z[m].T @ z[m] + 1e-3 * m.sum() * np.eye(129), z[m].T @ y[m])
    raw = np.array([a @ ridge(k != b) for a, b in zip(z, k)])
    bins = np.clip((raw + 0.5) / 2 * kernel.BINS, 0, kernel.BINS - 1).astype(int)
    at = np.unique(bins)
    n, share = np.array([(bins == b).sum() for b in at], float), np.array([y[bins == b].mean() for b in at])
    value = [max(min((share[a : b + 1] @ n[a : b + 1]) / n[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    score = np.clip(np.interp(feature(np.array([f[i] for i, _ in docs])) @ ridge(k >= 0), (at + 0.5) / kernel.BINS * 2 - 0.5, value), 0, 1)
    assert all(got[i][0] == held(i) for i, _ in docs)
    assert np.allclose([got[i][1] for i, _ in docs], score, atol=1e-3), max(abs(np.array([got[i][1] for i, _ in docs]) - score))

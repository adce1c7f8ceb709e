import functools
import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from meltemi.llm import toxicity

BAD = ["wretched", "scoundrel", "nitwit", "Dummkopf", "imbécile"]


def corpus(n):
    rnd = random.Random(4)
    make = lambda: "".join(rnd.choice(["an", "ti", "the", "or", "ed", "lo", "wha", "né"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [make() for _ in range(rnd.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(2 * bad):
            words.insert(rnd.randint(0, len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, "doc_id long, text string, y string, h string")
    rows = toxicity.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


@functools.lru_cache(maxsize=64)
def brute_compressor(dictionary):
    d = zstandard.ZstdCompressionDict(dictionary + toxicity.BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=toxicity.LEVEL)
    return zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def brute_length(dictionary, window):
    return len(brute_compressor(dictionary).compress(toxicity.BEFORE + window + toxicity.BEHIND))


def brute_statistic(model, text):
    """The rarity of a text's savings by plain compression of each of its words."""
    saved = []
    for w in text.lower().split():
        w = f" {w} ".encode()
        saved.append(min(40, max(0, brute_length(model.ordinary + bytes(len(model.toxic)), w) - brute_length(model.ordinary + model.toxic, w))))
    saved.sort(reverse=True)
    best = 0.0
    for k in range(1, min(12, len(saved)) + 1):
        m = len(saved) * model.chance[saved[k - 1]]
        if saved[k - 1] and m < k:
            best = max(best, math.log10(math.factorial(k)) - k * math.log10(m))
    return int(20 * best + 1e-9)


def brute_train(toxic, ordinary):
    """What tells, window by window against every part, and the dictionary that finds most of the texts kept aside."""
    flat = lambda x: b" " + b" ".join(x.decode().lower().encode().split()) + b" "
    taught, plain = ([flat(x) for k, x in enumerate(xs) if k % 4] for xs in (toxic, ordinary))
    ordinary_text = b"".join(plain)
    dictionaries = [ordinary_text[k : k + 131072] for k in range(0, len(ordinary_text), 131072)]
    found = {}
    for w in {b" " + w + b" " for t in taught for w in t.split()}:
        n = sum(w.strip() in t.split() for t in taught)
        if n >= 2:
            least = min(brute_length(b"".join(taught[k::8]), w) for k in range(8) if taught[k::8])
            if all(brute_length(d, w) > least for d in dictionaries):
                found[w] = n
    best = None
    for least in (2, 3, 5, 8):
        m = toxicity.Dictionaries(b"".join(w for _, w in sorted((n, w) for w, n in found.items() if n >= least)), dictionaries[0])
        if m.toxic:
            saved = [m.saving(b" " + w + b" ") for x in ordinary[::4] for w in flat(x).split()]
            m.chance = np.array([(sum(v >= s for v in saved) + 0.3) / (len(saved) + 1) for s in range(41)])
        stats = [(m.statistic(x), y) for y, xs in ((0, ordinary), (1, toxic)) for x in xs[::4]]
        f = max(2 * sum(y for s, y in stats if s >= t) / (sum(s >= t for s, _ in stats) + len(toxic[::4])) for t, _ in stats)
        if best is None or f > best[0]:
            best = f, m
    return best[1]


def brute_isotonic(points):
    """Values at ascending statistics: the least that is, over all later ends, the greatest mean of an earlier start on."""
    at = sorted({s for s, _ in points})
    mean = lambda a, b: np.mean([y for s, y in points if a <= s <= b])
    return at, [min(max(mean(a, b) for a in at if a <= s) for b in at if b >= s) for s in at]


def test_query_matches_brute_force(spark):
    docs, labels = corpus(420)
    docs += [(1000, None, "", ""), (1001, "", "", ""), (1001, "wretched nitwit", "", ""), (1002, "x " * 3000 + "scoundrel", "", "")]
    labels += [(1001, 1, 0), (1002, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, y string, h string").repartition(3)
    got = sorted((r.doc_id, r.held_out, r.score) for r in toxicity.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=60).collect())
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i, *_ in labels], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: t for i, _, t in labels if t is not None and not held(i)}
    sample = {i for k in (0, 1) for i in sorted((i for i, t in known.items() if t == k and hashes[i] % 2 == 0), key=hashes.get)[:60]}
    texts = sorted((hashes[i], (t or "").encode(), known[i]) for i, t, *_ in docs if i in sample and t is not None)
    model = brute_train([x for _, x, y in texts if y == 1], [x for _, x, y in texts if y == 0])
    assert model.toxic
    stat = [(i, brute_statistic(model, t or "")) for i, t, *_ in docs]
    at, value = brute_isotonic([(s, known[i]) for i, s in stat if i in known and i not in sample])
    want = sorted((i, held(i), float(np.interp(s, at, value))) for i, s in stat)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-9)


def test_windows_with_toxic_words_compress_better_with_the_toxic_dictionary():
    docs, labels = corpus(400)
    split = {k: [t.encode() for (_, t, *_), (_, _, x) in zip(docs, labels) if x == k] for k in (0, 1)}
    m = toxicity.train(split[1], split[0])
    for w in BAD:
        assert m.saving(b" " + w.lower().encode() + b" ") > 1, w
    plain = [m.saving(w) for x in split[0] for w in toxicity.windows(toxicity.normalised(x))]
    assert np.mean(plain) < 0.5
    # Every word of a text is in a window.
    words = [b"w%d" % k for k in range(83)]
    assert {w for x in toxicity.windows(words) for w in x.split()} == set(words)


def test_many_rare_insults_in_several_languages(spark):
    """Forty insults and stems, each in a few per cent of the toxic texts, two to six in a text."""
    rnd = random.Random(14)
    kinds = {
        "en": (["an", "ti", "the", "or", "ed", "lo", "wha"], ["wretch", "scoundrel", "nitwit", "fool", "scum", "moron", "liar", "pig", "swine", "dunce"]),
        "de": (["sch", "ein", "ung", "keit", "en", "der", "lich"], ["dummkopf", "trottel", "idiot", "schuft", "lump", "depp", "ekel", "gauner", "miststück", "arschloch"]),
        "fr": (["eau", "ment", "le", "tion", "ée", "qu", "re"], ["imbécile", "crétin", "abruti", "salaud", "ordure", "voyou", "menteur", "vaurien", "sot", "minable"]),
    }
    docs, labels = [], []
    for i in range(3000):
        syllables, bad = kinds[rnd.choice(list(kinds))]
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(8, 150))]
        toxic = i % 6 == 0
        for _ in range(rnd.randint(2, 6) * toxic):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    truth = dict(labels)
    rows = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(truth[r.doc_id] for r in held) and hit >= 0.9 * sum(r.predicted for r in held)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 500)
    docs, labels = corpus(200)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    y = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, y int").withColumn("h", F.xxhash64("doc_id"))
    _, toxic, plain = toxicity.sampled(d, y, 100)
    assert toxic and plain and sum(map(len, toxic)) <= 500 and sum(map(len, plain)) <= 500


def test_nulls_empty_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "wretched"), (3, "x" * 300_000), (4, "wretched " * 90_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(d, none).collect()] == [0.0] * 6
    assert toxicity.scored(d.limit(0), none).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.scored(d, some).count() == 6

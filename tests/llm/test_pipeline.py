"""Each stage of the pipeline against a brute-force version on a small fixture."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from meltemi.llm import queries
from tests.llm.test_jaccard import grams

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    word = lambda: rnd.choice(["the", "of", "and", "is"]) if rnd.random() < 0.3 else f"word{rnd.randint(0, 3000)}"
    docs, labels = [], []
    for i in range(160):
        if i % 8 == 7:
            text = "spam### " * rnd.randint(30, 90)
        elif i % 5 == 4 and (i - 1) % 8 != 7:
            w = docs[i - 1][1].split(" ")
            w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = " ".join(word() for _ in range(rnd.randint(60, 200))) + " mail me.7@mail1.example.com"
        docs.append((i, text, "en", rnd.choice(["a", "b", None]), len(text)))
        labels.append((i, int(i % 8 != 7), 0))
    return docs, labels


def kept(rows, num=80, den=100):
    sets, comp = {r[0]: grams(r[1], 5) for r in rows}, {r[0]: r[0] for r in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i for i in sets if comp[i] == i or not sets[i]}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = corpus()
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [[tuple(r) for r in df.collect()]]
    for name, stage in cp.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            seen.append([tuple(r) for r in df.collect()])
    raw, good, single, masked, mix = seen
    assert set(good) <= set(raw) and {r[0] for r in good} == {i for i, q, _ in labels if q}
    assert {r[0] for r in single} == kept(good) and set(single) <= set(good)
    assert {r[0] for r in masked} == {r[0] for r in single} and not any("me.7@" in r[1] for r in masked)
    assert all(len(r[1]) == r[4] for r in masked)
    n = Counter(r[0] for r in mix)
    assert set(mix) <= set(masked) and max(n.values()) <= 2
    total = sum(len(r[1].split()) for r in masked)
    assert abs(sum(len(r[1].split()) for r in mix) - 1.5 * total) <= 200
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r[0], hashlib.sha256(np.array(t.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in mix)
    assert Counter((r.doc_id, r.ids_sha256) for r in df.collect()) == want

"""The whole pipeline on an empty table, and on rows of null and repeated ids, nulls, equal rows, a very long text and clashing columns."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from tests.llm.test_pipeline import COLUMNS

EXTRA = ", copies long, size string, node string, h int, pii string"


def through(spark, tmp_path, rows, labels):
    docs = spark.createDataFrame(rows, COLUMNS + EXTRA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert df.columns == docs.columns
        out[name] = df.collect()
    return out


def test_empty_table(spark, tmp_path):
    assert all(rows == [] for rows in through(spark, tmp_path, [], []).values())


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    a, b, long = text(50), text(60), text(60_000)
    rows = [(1, a, "en", "s", len(a)), (1, b, "en", None, len(b)), (None, text(30), None, "s", None), (4, None, "en", "s", None), (5, "", "en", "s", 0), (6, long, "en", "t", len(long))]
    rows += [(7, text(40), "en", "t", 1)] * 3
    # No labels: the classifier rejects nothing.
    out = through(spark, tmp_path, [(*r, 9, "x", "y", 2, "z") for r in rows], [])
    count = lambda name: Counter(r.doc_id for r in out[name])
    assert count("quality") == {1: 2, None: 1, 4: 1, 5: 1, 6: 1, 7: 3}
    assert count("near_copies") == count("pseudonyms") == {1: 2, None: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert {r.text for r in out["near_copies"]} == {r[1] for r in rows}
    mixed = Counter((r.doc_id, r.text) for r in out["mixture"])
    assert max(mixed.values()) <= 2 and mixed[4, None] == mixed[5, ""] == 1
    before, after = (sum(len((r.text or "").split()) for r in out[x]) for x in ("pseudonyms", "mixture"))
    assert after <= 2 * before and len(out["tokens"]) == len(out["mixture"])
    assert all(len(r.ids) == r.n_tokens for r in out["tokens"])

"""Rows of null and of repeated doc_id through the pipeline's joining stages."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from tests.llm.test_pipeline import COLUMNS


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], COLUMNS).repartition(3)


def test_near_copies_keep_null_and_repeated_ids(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    # a: an id and a null id; b: null ids alone; c: repeated row; d, e: one id, texts of their own; and rows without words.
    rows = [(5, a), (None, a), (None, b), (None, b), (7, c), (7, c), (8, d), (8, e), (None, ""), (None, "")]
    got = Counter((r.doc_id, r.text) for r in cp.near_copies(spark, table(spark, [(*r, "s") for r in rows]), "").collect())
    assert got == Counter([(5, a), (None, b), (7, c), (8, d), (8, e), (None, ""), (None, "")])


def test_mixture_takes_rows_at_most_twice(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join([f"t{k}"] + ["x"] * rnd.randint(5, 60)), rnd.choice(["a", "b"])) for k, i in enumerate([None] * 30 + [1] * 30 + [2] * 5 + list(range(10, 60)))]
    total = sum(len(t.split()) for _, t, _ in rows)
    out = [r.text for r in cp.mixture(spark, table(spark, rows), "").collect()]
    assert max(Counter(out).values()) <= 2 and any(t in set(out) for i, t, _ in rows if i is None)
    assert abs(sum(len(t.split()) for t in out) - 1.5 * total) <= 200

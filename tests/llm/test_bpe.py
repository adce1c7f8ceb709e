import hashlib
import random

import numpy as np
import pytest

from meltemi.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def corpus():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "don't", "naïve", "42", "--", "日本語", "x y", " ", "🙂", "<|endoftext|>", "  ", "\n\n", "a" * 70, "ß", "we'll"])
    passages = [" ".join(word() + str(rnd.randint(0, 99)) for _ in range(rnd.randint(200, 900))) for _ in range(5)]
    passages += ["z" * 9000, " " * 5000 + "q", "".join(rnd.choice("ab<|>é ") for _ in range(9000)), "語" * 4000]
    texts = [None, "", " ", "<|endoftext|>", "a"]
    for _ in range(60):
        texts.append("".join(rnd.choice([" ", "", "\n"]).join([rnd.choice(passages), word()]) for _ in range(rnd.randint(1, 4))))
    return texts + passages * 2


def test_matches_the_library(spark, monkeypatch):
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, h int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encoded(df, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = bpe.encoded(df, PATH, with_ids=True).collect()
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == want[r.doc_id][1] for r in rows)


def test_shared_passages_share_chunks():
    rnd = random.Random(1)
    make = lambda n: "".join(rnd.choice("abcdefg hij") for _ in range(n)).encode()
    p = make(20_000)
    a, b = make(777) + p, make(3000) + p + make(50)
    ha, hb = (set(bpe.hashes(t, e)) for t, e in zip([a, b], bpe.cuts([a, b])))
    assert len(ha & hb) > 10
    assert [e.tolist() for e in bpe.cuts([a, b])] == [bpe.cuts([a])[0].tolist(), bpe.cuts([b])[0].tolist()]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encoded(df, PATH).collect()) == [0, 2, 2]
    assert bpe.encoded(df.limit(0), PATH).count() == 0


def test_bytes_that_are_no_utf8(spark):
    raw = [b"ab\xff cd", b"\xe6\x97 x", b"\x80" * 5000 + b" tail"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "doc_id long, b binary").selectExpr("doc_id", "cast(b AS string) AS text")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encoded(df, PATH).collect()}
    assert [got[i] for i in range(len(raw))] == brute([x.decode("utf-8", "replace") for x in raw])


def test_more_repeated_chunks_than_the_filter_holds(spark, monkeypatch):
    """Only the most frequent chunks are shared then, and results stay the same."""
    monkeypatch.setattr(bpe, "FILTER_BITS", 256)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encoded(df, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_worker_encodes_a_stretch_once():
    codec = bpe.Codec(PATH)
    texts = ["one more two", "two more", "語 one", ""]
    got = codec.encode([t.encode() for t in texts])
    assert [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()) for x in got] == [x[:2] for x in brute(texts)]
    assert {"one", " more", " two", "語"} <= set(codec.coder.known)

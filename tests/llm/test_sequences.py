import random
import zlib

import numpy as np
import pytest

from meltemi.llm import sequences
from tests.llm.test_bpe import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def best_fit(lengths, size):
    """Best fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    return len(room)


def test_ids_are_the_librarys():
    rnd = random.Random(12)
    texts = [t or "" for t in corpus()]
    alphabet = ["a", "B", "é", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "\x0b", "7", "½", "!", "<|endoftext|>", "語", "🙂", "́", "_", "²"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    got = sequences.Stretches(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts)


def test_worker_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(sequences, "KEPT", 50)
    coder, texts = sequences.Stretches(PATH), [f"one {i} two {i % 7} three" for i in range(300)]
    got = [x for i in range(0, 300, 20) for x in coder.encode(texts[i : i + 20])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts)
    assert len(coder.known) < 120


@pytest.mark.parametrize("size", [16, 1024])
def test_packs_every_piece_once(spark, size):
    texts = [t if size > 99 else t and t[:900] for t in corpus()] + ["the same text"] * 400
    ids = [x + [2] for x in library(texts)]
    df = spark.createDataFrame([(None if i % 9 == 0 else i, t, 1, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, length int, task string, rank int").repartition(7)
    rows = sequences.packed(df, PATH, size).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, want in enumerate(ids):
        if i % 9:
            got = sorted(by_doc[i], key=lambda r: r.piece)
            first = (len(want) - 1) % size + 1
            cuts = [0, *range(first, len(want), size)]
            assert [(r.piece, r.start, r.length) for r in got] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(want)]))]
            assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) for r in got]
    assert sum(r.length for r in by_doc[None]) == sum(len(x) for i, x in enumerate(ids) if i % 9 == 0)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) == best_fit([r.length for r in rows], size)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(300):
        size = rnd.choice([7, 30, 64])
        lengths = [min(size, max(1, int(rnd.lognormvariate(rnd.choice([0.5, 2, 3]), 1)))) for _ in range(rnd.randint(1, 400))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = sequences.planned(counts, size)
        assert sum(n for n, _ in plan) == best_fit(lengths, size)
        assert all(sum(x * m for x, m in kind) <= size and n > 0 for n, kind in plan)
        assert {x: sum(n * m for n, kind in plan for y, m in kind if y == x) for x in counts} == counts
        assert len(plan) <= 2 * size


def test_plan_of_a_corpus_is_as_small_as_one_of_its_histogram():
    counts = {n: 10**9 // n for n in range(1, 1025)}
    plan = sequences.planned(counts, 1024)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(n for n, _ in plan) <= least * 1.001
    assert len(plan) <= 2048 and len(sequences.slots(plan)["length"]) < 90_000


def test_ranks_of_one_length_take_all_its_slots():
    table = sequences.slots([(2, [(5, 1), (2, 2)]), (3, [(2, 4)])])
    assert list(zip(*(table[k].tolist() for k in ("length", "first", "each", "sequence", "at")))) == [(2, 0, 2, 0, 5), (2, 4, 4, 2, 0), (5, 0, 1, 0, 0)]


def test_no_documents(spark):
    assert sequences.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

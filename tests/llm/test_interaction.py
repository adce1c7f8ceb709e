import itertools
import random
import re

import pytest

from meltemi.llm import interaction

SCHEMA = "doc_id long, text string, source string, failed int, key int, n long, part string"


def brute(docs, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        rows.append((i, s or "", fails))
    out, total = [], {}
    for part in {p for _, p, _ in rows}:
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[1] == part]
            gone = []
            for k, f in enumerate(order, 1):
                lost = [r for r in alive if f in r[2]]
                again = sum(f in r[2] for r in gone)
                alive = [r for r in alive if f not in r[2]]
                gone += lost
                only = sum(r[2] == {f} for r in rows if r[1] == part)
                total[part, f] = total.get((part, f), 0) + len(lost)
                out.append((part, "".join(order), k, len(alive), len(lost), again, only, sum(r[0] in good for r in lost), sum(r[0] in bad for r in lost)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    make = lambda n, k=300: " ".join(rnd.choice(words[:k]) for _ in range(n))
    long = make(9000)
    texts = [None, "", "", " \t\n", make(60), make(49), make(50), make(80, 5), make(70).upper(), make(60) + " a|b", "é" * 700, "é" * 699 + "e", "ﾀ b " * 60]
    texts += [long, long, long[:-1] + "!", "!" + long[1:], make(60)] + [make(55)] * 3
    docs = [(i, t, rnd.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [(rnd.randint(0, 60), rnd.choice(texts), rnd.choice("ab")) for _ in range(120)] + [(None, long, "a"), (None, "", "b"), (3, "", None), (3, "", None)]
    rnd.shuffle(docs)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(40)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("bits", [64, 3])
def test_every_order_document_by_document(spark, bits):
    """With hashes of three bits nearly all classes hold several texts, and nothing changes."""
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, 7, 7, 7, "x") for r in docs], SCHEMA).repartition(5)
    y = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, n int")
    assert sorted(map(tuple, interaction.audited(d, y, bits=bits).collect())) == brute(docs, labels)


def test_marks_are_by_text_alone(spark):
    docs, _ = corpus()
    got = interaction.marked(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)).collect()
    want = sorted((i or -1, s or "", any(j is not None and i is not None and j < i and (u or "") == (t or "") for j, u, _ in docs)) for i, t, s in docs)
    assert sorted((r.doc_id or -1, r.part, bool(r.failed & 16)) for r in got) == want


def test_one_text_in_most_rows(spark):
    """A hot class stays where its rows are; the smallest id alone is kept."""
    d = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 < 3, 'the same', concat('text ', id)) as text", "'s' as source")
    got = interaction.marked(d).groupBy("failed").count().collect()
    assert {r.failed: r["count"] for r in got} == {1: 1001, 17: 2999}


def test_refinement_splits_by_code_points_first():
    assert interaction.failures("aé".encode())[1] == 2
    a, b = (interaction.refinement(t, 300) for t in (b"x" * 299 + b"a", b"x" * 299 + b"b"))
    assert a[:2] == b[:2] and a[2] != b[2] and len(a) == 3


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audited(empty, y).count() == 0

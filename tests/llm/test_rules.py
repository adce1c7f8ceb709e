import random
import re
from collections import Counter

from meltemi.llm.rules import STOP_WORDS, quality_rules, text_metrics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    stop = sum(w.lower() in STOP_WORDS for w in words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), stop


def test_metrics_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \t\n\x0b\r", "a", "é # |\n\né # |\n", "x " * 9, "the of " * 400 + "end", "  no break"]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))).replace("b a", "b\na") for _ in range(60)]
    texts += ["w " * 50_000 + "tail"]
    rows = list(enumerate(texts)) * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as n_words", "1 as _text")
    got = Counter(tuple(r) for r in text_metrics(df).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_verdicts(spark):
    clean = " ".join(f"the word{i} of sentence{i}" for i in range(20))
    rows = [(1, clean), (2, "too short"), (3, "same words again and again in this very line " * 9), (4, clean.replace(" ", "## ")), (5, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0

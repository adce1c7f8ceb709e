"""Quality rules: a threshold table compiled into one native projection.

Every metric of a text is an array expression over its words and lines; the table of thresholds becomes one boolean
column. There is no shuffle and no user function, so the plan is a scan and projections at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.llm.shared import pruned

SPACE = "[ \\t-\\r]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for was on are as he by this from or an at "
    "de la le les des et en un une du que qui dans pour sur est au par pas "
    "der die das und zu den von mit ist nicht ein eine dem sich auf für als auch es "
    "el los las y por con para una su se no lo como más del"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if numerator / denominator (0 where the denominator is 0) lies within [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")


RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", low=2.0, high=16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.2),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("words_per_line", "n_words", "n_lines", low=2.0),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The whole table as one boolean column."""
    out = F.lit(True)
    for r in rules:
        ratio = F.when(F.col(r.denominator) == 0, F.lit(0.0)).otherwise(F.col(r.numerator) / F.nullif(F.col(r.denominator), F.lit(0)))
        out = out & ratio.between(F.lit(r.low), F.lit(r.high))
    return out


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (long).

    Null text counts as empty: all zero. Repeated rows give repeated rows. Lines are split at line feeds, and those
    without a word don't count. n_repeat_words counts the words that lie in a window of `window` words that the text
    holds twice or more, the first included.
    """
    base = pruned(docs, id_col, text_col).select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.select(id_col, "_text", F.filter(F.split("_text", f"{SPACE}+", -1), lambda x: x != "").alias("_words"))
    stop = F.lit(0).cast("long") + F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    base = base.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("_lines"),
        stop.alias("n_stop_words"),
        F.when(F.size("_words") >= window, F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    # Only texts that hold some window twice are sorted; the rest end at the comparison of two sizes.
    base = base.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_stop_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    same = lambda s, k: F.coalesce(F.get("_sorted", k)["h"] == s["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))
    base = base.select("*", places.alias("_at"))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_at", k + 1) - p, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return base.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_stop_words"
    )


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """text_metrics() with base_failed (too short or too repetitive) and kept (neither that nor outside a rule)."""
    m = text_metrics(docs, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def _sql_ratio(r: Rule) -> str:
    ratio = f"CASE WHEN {r.denominator} = 0 THEN 0::DOUBLE ELSE {r.numerator}::DOUBLE / nullif({r.denominator}, 0) END"
    parts = [f"({ratio}) >= {r.low!r}::DOUBLE"] * (r.low > float("-inf")) + [f"({ratio}) <= {r.high!r}::DOUBLE"] * (r.high < float("inf"))
    return " AND ".join(parts)


ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains([{", ".join(repr(s) for s in STOP_WORDS)}], lower(x))))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(_sql_ratio(r) for r in RULES)} AS kept FROM b
"""

"""Filter interaction audit: what each filter removes in every order of all of them, and alone.

Whether a text is an exact copy is found by partition refinement: documents are split by their number of code points,
then by the hashes of successive blocks, and whoever is left alone in a class goes. Full texts are compared only of those
that stay together to the end; the hashes never decide. Then documents are counted by the set of filters that they fail,
and these counts tell every order.
"""

from __future__ import annotations

import itertools
import json
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.shared import classed, pruned, short_batches, written
from meltemi.llm.shingles import runs

FILTERS = "ABCDE"
#: Bytes of the first block; each further one is so many times as long.
BLOCK, GROWTH = 256, 16
#: Bits of the filter of classes (512 KB); it only saves shuffles, and never decides.
FILTER_BITS = 1 << 22

_UPPER, _ODD, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> tuple[int, int]:
    """(bits of the filters A to D that the text fails, its code points)."""
    words = text.split()  # of bytes at ASCII white space, which is what separates words here
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    short, dull = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    return short | dull << 1 | (100 * upper > 5 * points) << 2 | (len(text) != len(text.translate(None, _ODD))) << 3, points


def refinement(text: bytes, points: int, bits: int = 64) -> list[int]:
    """The text's class by code points, then with each block more; the last one tells of the whole text."""
    out, at, size = [points], 0, BLOCK
    while at < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[at : at + size], out[-1]) >> (64 - bits))
        at, size = at + size, size * GROWTH
    return out


def _facts(batches, bits: int, passing: np.ndarray | None, names: list[str]):
    """doc_id, part, failed, classes and, where passing tells which ones are wanted, the text."""
    for b in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(2)]
        for i, j in runs(texts):
            failed, keys, rows = [], [], []
            for k in range(i, j):
                f, points = failures(texts[k])
                chain = refinement(texts[k], points, bits)
                if passing is None or passing[chain[-1] % FILTER_BITS]:
                    failed.append(f)
                    keys.append(chain)
                    rows.append(k)
            sizes = np.cumsum([0, *map(len, keys)])
            flat = np.array([x for c in keys for x in c], np.uint64).view(np.int64)
            key = flat[sizes[1:] - 1]
            cols = [b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64())), pa.array(failed, pa.int32()), pa.array(key)]
            if passing is None:
                cols.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)))
            else:
                cols.append(pa.array([texts[k] for k in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names)


def _passing(keys: DataFrame) -> np.ndarray:
    """Which remainders of the classes' keys occur; at most FILTER_BITS / 32 rows come to the driver."""
    bit = keys.select(F.expr(f"pmod(key, {FILTER_BITS}L)").alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in bit.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("m")).collect():
        out[r.w] = r.m
    return np.unpackbits(out.astype("<u4").view(np.uint8), bitorder="little").astype(bool)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, part, failed; bit k of failed tells that it fails the filter FILTERS[k].

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * A-Z characters > 5 * code points; D: any of #$%&*|;
    E: identical to the text of a smaller id. Null text is empty, a null part the empty string. A null id is smaller
    than none and none is smaller than it, and of equal ids neither is the smaller one. bits: of the hashes, fewer in
    tests only.
    """
    short_batches(docs.sparkSession)
    d = pruned(docs, id_col, part_col, text_col).toDF("doc_id", "part", "text").withColumn("part", F.coalesce("part", F.lit("")))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, part string, failed int, key long"

    def facts(passing=None):
        last = "keys array<long>" if passing is None else "text binary"
        names = ["doc_id", "part", "failed", "key", last.split()[0]]
        return d.mapInArrow(lambda batches: _facts(batches, bits, passing, names), f"{schema}, {last}")

    rows = written(facts(), "facts")
    total, depth = rows.agg(F.count("*"), F.max(F.size("keys"))).first()
    left, n_left = rows.select("keys"), total
    for level in range(depth or 0):
        left = left.withColumn("key", F.expr(f"get(keys, least({level}, size(keys) - 1))"))
        together = written(left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "together")
        left = written(classed(left, together, "key", n_left).select("keys"), "left")
        n_left = left.count()
        if not n_left:
            break
    drawn = facts(_passing(left.select(F.expr("get(keys, size(keys) - 1)").alias("key"))))
    # Equal texts collapse in the tasks that read them, however many there are.
    same = drawn.groupBy("key", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    same = written(same.groupBy("key").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1"), "same")
    copy = (F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16 + F.col("failed")).alias("failed")
    out = ["doc_id", "part", copy]
    several = same.where("texts > 1").select("key")
    if several.isEmpty():
        return classed(rows.drop("keys"), same.drop("texts"), "key", total, "left").select(*out)
    # Different texts under one hash: these classes are compared text by text.
    drawn = written(facts(_passing(several)).join(several, "key", "left_semi"), "several")
    least = drawn.groupBy("key", "text").agg(F.min("doc_id").alias("least"))
    rest = rows.drop("keys").join(several, "key", "left_anti")
    return classed(rest, same.where("texts = 1").drop("texts"), "key", total, "left").select(*out).union(drawn.join(least, ["key", "text"]).select(*out))


def steps(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: the filters before it and after it as bits, and which one it applies."""
    out = []
    for order in itertools.permutations(filters):
        before = 0
        for k, f in enumerate(order, 1):
            bit = filters.index(f)
            out.append({"filter_order": "".join(order), "step": k, "bit": bit, "before": before, "after": before | 1 << bit})
            before |= 1 << bit
    return out


def audited(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step keeps, removes and loses there.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. labels
    (doc_id, quality, toxic) may repeat an id: one row with 1 suffices; null ids have no label. No documents: no rows.
    """
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    # By id before the labels come, so that rows of one id meet them as a few rows.
    counts = marked(docs, bits=bits).groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n"))
    y = pruned(labels, "doc_id", "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    y = y.groupBy("doc_id").agg(F.max(F.expr("quality <=> 1").cast("int")).alias("good"), F.max(F.expr("toxic <=> 1").cast("int")).alias("toxic"))
    counts = counts.join(y, "doc_id", "left").groupBy("part", "failed")
    counts = counts.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])
    # At most 2 ** 5 entries a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("_sets"))

    def passing(c):
        """For each set of filters, as bits, the documents that fail none of them."""
        own = lambda s: F.filter("_sets", lambda x: x["failed"].bitwiseAND(s) == 0)
        return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.aggregate(own(s), F.lit(0).cast("long"), lambda a, x: a + x[c]))

    parts = parts.select("part", *[passing(c).alias(f"_{c}") for c in ("n", "good", "toxic")])
    at = lambda c, s: F.get(F.col(c), s if not isinstance(s, int) else F.lit(s))
    shapley = []
    for k in range(n):
        others = [s for s in range(full + 1) if not s >> k & 1]
        weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in others}
        shapley.append(sum(((at("_n", s) - at("_n", s | 1 << k)) * weight[s] for s in others), F.lit(0).cast("long")))
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, bit: int, before: int, after: int>>")
    out = parts.select("*", F.array(*shapley).alias("_shapley")).select("*", F.explode(table).alias("s")).select("*", "s.*")
    own = F.col("after") - F.col("before")
    removed = at("_n", F.col("before")) - at("_n", F.col("after"))
    return out.select(
        "part",
        "filter_order",
        "step",
        at("_n", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (at("_n", 0) - at("_n", own) - removed).alias("redundant"),
        (at("_n", F.lit(full) - own) - at("_n", full)).alias("unique_fails"),
        (at("_good", F.col("before")) - at("_good", F.col("after"))).alias("good_lost"),
        (at("_toxic", F.col("before")) - at("_toxic", F.col("after"))).alias("toxic_lost"),
        at("_shapley", F.col("bit")).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w
  FROM documents
), f AS (
  SELECT doc_id, part,
         (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS m
  FROM d
), y AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), c AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS x
  FROM f LEFT JOIN y USING (doc_id) GROUP BY part, m
), l AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(a, b)
), o AS (
  SELECT l1.a || l2.a || l3.a || l4.a || l5.a AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
  FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31
    AND l1.b <> l2.b AND l1.b <> l3.b AND l1.b <> l4.b AND l1.b <> l5.b AND l2.b <> l3.b
    AND l2.b <> l4.b AND l2.b <> l5.b AND l3.b <> l4.b AND l3.b <> l5.b AND l4.b <> l5.b
), s AS (
  SELECT filter_order, k AS step, bits[k] AS b, list_sum(bits[1:k])::int AS after, list_sum(bits[1:k])::int - bits[k] AS before
  FROM o, range(1, 6) r(k)
), r AS (
  SELECT part, filter_order, step, b,
         sum(CASE WHEN m & after = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m & before <> 0 AND m & b <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
       unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, b))::bigint AS shapley
FROM r
"""

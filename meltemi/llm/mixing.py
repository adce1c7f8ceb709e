"""Mixing sources to target weights by entropy balancing.

Each document gets a rate in [0, 2]. Among all rates that give every source its target number of words, those nearest
in relative entropy to taking each document once are min(2, exp(lambda * size)), with one dual variable lambda per
source. The dual is convex and a safeguarded Newton iteration solves it for all sources at once: every step is one
distributed aggregation of the sums at the current lambdas. Documents of one size and source have one rate, so sums
run over counts by source and size. Rates become copies 0, 1 or 2 per size class with the error carried from class to
class, largest first, and a hash of the document decides who within a class gets the odd copy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.llm.shared import pruned, written
from meltemi.sources.files import numbered

WEIGHTS = (3, 1, 2)
MOST = 2.0
#: Places within a size class; only rows of the one place where the odd copies end are ranked.
PLACES = 256
TOLERANCE = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = MOST) -> DataFrame:
    """From (source, source_size), one row per source, the same with target double.

    Weights repeat over the sources by code point, null last. The total is share * all sizes; a target stops at
    most * its source's size, and what that leaves is shared anew by weight until none is above. Each turn is one sum
    over the sources and stops some; there are a few at most, as later ones stop ever fewer.
    """
    w = F.get(F.array(*map(F.lit, weights)), F.pmod("id", F.lit(len(weights))).cast("int")).cast("double")
    keyed = numbered(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source")
    s = written(keyed.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")), "weights")
    total = s.agg(F.sum("source_size")).first()[0]
    level, stopped = None, -1
    while total is not None:
        # With every target at its stop or at level * weight; all stop where the share is the most itself.
        stops = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("w")
        n, taken, left = s.agg(F.count(F.when(stops, 1)), F.sum(F.when(stops, F.col("cap")).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("w")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (share * total - taken) / left
    return s.select("source", "source_size", F.least("cap", F.lit(level or 0.0) * F.col("w")).alias("target"))


def solved(cells: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """The dual variable of each source: (source, target, lam).

    cells: source, size, n; goals: source, source_size, target. Where a target is most * its source's size, all rates
    are at their bound. For the others every step adds up, by source, the words taken at the current lambda and their
    derivative over all cells, and then takes a Newton step on the logarithm of the words, or halves the bracket where
    that step leaves it or the last one didn't halve the distance to the target. It goes on until all sources agree with
    their target to the tolerance or their bracket holds no number any more; one of both is reached for certain.
    """
    c = cells.where("size > 0")
    least = c.groupBy("source").agg(F.min("size").alias("least"))
    s = goals.where("source_size > 0").alias("g").join(least.alias("l"), F.expr("g.source <=> l.source")).select("g.*", "l.least")
    # The words taken are within exp(lambda * least) of their bounds, which brackets lambda; capped at 2 for all sizes.
    edge = F.log(F.col("target") / F.col("source_size")) / F.col("least")
    s = s.select("source", "target", F.least(edge, F.lit(0.0)).alias("lo"), F.when(edge > 0, F.log(F.lit(most)) / F.col("least")).otherwise(0.0).alias("hi"), (F.col("target") >= most * F.col("source_size")).alias("stopped"))
    lam = F.when(F.col("stopped"), F.col("hi")).when(F.col("lo") < 0, F.col("lo") / 64).otherwise(F.col("hi") / 64)
    s = written(s.select("source", "target", "lo", "hi", lam.alias("lam"), F.col("stopped").alias("done"), F.lit(None).cast("double").alias("was")), "dual")
    while not s.where("not done").isEmpty():
        x = s.where("not done").withColumnRenamed("source", "_s")
        j = c.join(x, c["source"].eqNullSafe(x["_s"]))
        e = F.col("lam") * F.col("size")
        words = F.col("n") * F.col("size")
        taken = F.when(e >= F.log(F.lit(most)), most * words).otherwise(words * F.exp(e))
        slope = F.when(e >= F.log(F.lit(most)), 0.0).otherwise(words * F.col("size") * F.exp(e))
        g = j.groupBy("_s").agg(F.sum(taken).alias("g"), F.sum(slope).alias("d"))
        n = s.join(g, s["source"].eqNullSafe(g["_s"]), "left").drop("_s")
        lo = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.nullif(F.col("d"), F.lit(0.0))
        n = n.select("source", "target", "done", "was", "lam", lo.alias("lo"), hi.alias("hi"), step.alias("step"), (F.abs(F.col("g") / F.col("target") - 1)).alias("off"))
        slow = F.col("was").isNotNull() & (F.col("off") > F.col("was") / 2)
        newton = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")) & ~slow
        middle = (F.col("lo") + F.col("hi")) / 2
        # A middle that is one of the ends leaves no number between them.
        done = F.col("done") | (F.col("off") <= tolerance) | (middle == F.col("lo")) | (middle == F.col("hi"))
        lam = F.when(done, F.col("lam")).when(newton, F.col("step")).otherwise(middle)
        s = written(n.select("source", "target", "lo", "hi", lam.alias("lam"), done.alias("done"), F.when(newton, F.col("off")).alias("was")), "dual")
    return s.select("source", "target", "lam")


def rounded_sizes(size: np.ndarray, n: np.ndarray, rate: np.ndarray, most: int = int(MOST)) -> np.ndarray:
    """Copies of each size class of a source, sizes descending: n * rate, with the error carried from class to class.

    What the bounds 0 and most * n leave over at the end goes to the largest classes that have room for it, so that no
    class with room holds a document as small as what is left.
    """
    carry, out = 0.0, np.zeros(len(size), np.int64)
    for i in range(len(size)):
        if not size[i]:
            out[i] = n[i]
            continue
        out[i] = max(0, min(most * n[i], round(n[i] * rate[i] + carry / size[i])))
        carry += (n[i] * rate[i] - out[i]) * size[i]
    for i in range(len(size)):
        if size[i] and abs(carry) >= size[i]:
            k = max(-out[i], min(most * n[i] - out[i], int(carry / size[i])))
            out[i] += k
            carry -= k * size[i]
    return out


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, rate, copies.

    size counts the words of the text (null: 0); taken = copies * size, with copies 0, 1 or 2. The words taken of a
    source differ from its target by less than the smallest document of which a copy more (or less) could be taken.
    Documents without words are taken once.
    Nulls form a source of their own. The hash is of hash_col, or else of the id; rows of equal hash_col share it, so
    which of them is taken twice is arbitrary but equal in number. Reruns agree.
    """
    d = pruned(docs, id_col, source_col, text_col, hash_col or id_col).toDF("doc_id", "source", "text", "key")
    size = F.coalesce(F.size(F.filter(F.split("text", "[ \\t-\\r]+", -1), lambda x: x != "")).cast("long"), F.lit(0).cast("long"))
    place = F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(PLACES)).cast("int")
    rows = written(d.select("doc_id", "key", "source", F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size"), place.alias("place")), "sizes")
    by_place = written(rows.groupBy("source", "size", "place").agg(F.count("*").alias("n")), "places")
    cells = written(by_place.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = written(targets(sources, weights, share), "targets")
    duals = solved(cells, goals).select(F.col("source").alias("_s"), "lam")
    x = cells.join(duals, cells["source"].eqNullSafe(duals["_s"]), "left").drop("_s")
    rate = F.least(F.lit(MOST), F.exp(F.col("lam") * F.col("size")))
    rated = x.select("source", "size", "n", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(1.0))).alias("rate"))

    def rounded(part):
        """Copies of each size class of one source; at most one row per distinct size."""
        part = part.sort_values("size", ascending=False)
        total = rounded_sizes(*(part[c].to_numpy() for c in ("size", "n", "rate")))
        return part.assign(total=total)[["source", "size", "rate", "total"]]

    kind = cells.schema["source"].dataType.simpleString()
    classes = rated.groupBy("source").applyInPandas(rounded, f"source {kind}, size long, rate double, total long")
    # Each document of a class gets total div n copies; the remainder fills the places in order.
    p = by_place.alias("p").join(classes.alias("c"), F.expr("p.source <=> c.source and p.size = c.size")).select("p.source", "p.size", "p.place", "p.n", "rate", "total")
    w = Window.partitionBy("source", "size")
    p = p.withColumn("all", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    odd = F.col("total") % F.col("all") - F.coalesce(F.col("before"), F.lit(0).cast("long"))
    p = p.select("source", "size", "place", "n", "rate", F.expr("total div all").alias("base"), F.greatest(F.lit(0), F.least(F.col("n"), odd)).alias("odd"))
    p = p.alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source")).select("p.*", "g.source_size", "g.target")
    j = rows.alias("r").join(p.alias("p"), F.expr("r.source <=> p.source and r.size = p.size and r.place = p.place"))
    j = written(j.select("r.doc_id", "r.key", "r.source", "r.size", "r.place", "p.source_size", "p.target", "p.rate", "p.base", "p.odd", "p.n"), "shares")
    # Ranked are only the places that some but not all rows of get one more.
    some = F.expr("odd > 0 and odd < n")
    rank = F.row_number().over(Window.partitionBy("source", "size", "place").orderBy(F.xxhash64(F.lit(29), "key"), "doc_id"))
    whole = j.where(~some).withColumn("copies", F.col("base") + (F.col("odd") > 0).cast("long"))
    split = j.where(some).withColumn("copies", F.col("base") + (rank <= F.col("odd")).cast("long"))
    out = whole.unionByName(split)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")

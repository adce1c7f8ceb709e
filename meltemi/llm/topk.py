"""Exact top-k inner products by a three-phase uniform threshold.

The score of a pair is the sum of the local scores of m nodes, each a stretch of the dimensions. Phase one gathers, for
each query in one block of candidates, the k best of each node's local list and scores these exactly; the k-th best of
them is a cutoff that the true k-th best reaches. Phase two sends the cutoff with its query to all blocks and collects
what can still reach it: a pair whose local scores are all below cutoff / m cannot, nor one whose known scores and
cutoff / m for the others add up to less. Phase three resolves exactly what is left, and only that, and keeps the k best.
Vectors travel in packs of the smallest whole-number type: a pack of queries once to each block of candidates, a block
once to each slice of queries. No pair leaves its block before it has passed the cutoff.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.llm.shared import pruned, written

NODES = 4
#: Vectors of a pack; packs of a block of candidates and of a slice of queries.
PACK, BLOCK, SLICE = 1024, 16, 32
CELLS = 1 << 20
NONE = np.iinfo(np.int64).min


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _nodes(width: int) -> list[slice]:
    cut = np.linspace(0, width, NODES + 1).astype(int)
    return [slice(a, b) for a, b in zip(cut, cut[1:])]


def packs(rows: DataFrame, width: int) -> DataFrame:
    """rows (vec_id, v) as packs: pack, ids binary, v binary, kind (the type of v's numbers), zeros up to width."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, PACK):
                part = b.slice(i, PACK)
                v = part.column(1)
                n = np.diff(v.offsets.to_numpy())
                a = np.zeros((len(n), width), np.int64)
                a[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
                kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= a.min(initial=0) and a.max(initial=0) <= np.iinfo(k).max)
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([a.astype(kind).tobytes()], pa.binary()), pa.array([kind])], ["ids", "v", "kind"])

    out = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, "ids binary, v binary, kind string")
    return out.select(F.monotonically_increasing_id().alias("pack"), "*")


def _opened(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the packs of a group, in the order of the ids."""
    ids = [np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()]
    v = [np.frombuffer(x, k).reshape(-1, width).astype(np.int64) for x, k in zip(t["v"].to_pylist(), t["kind"].to_pylist())]
    ids, v = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros((0, width), np.int64), *v])
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def _steps(q: np.ndarray, n: int):
    """Runs of queries whose scores against n candidates fill CELLS numbers."""
    step = max(1, CELLS // max(1, n))
    for i in range(0, len(q), step):
        yield i, min(i + step, len(q))


def cutoffs(qi: np.ndarray, qv: np.ndarray, ci: np.ndarray, cv: np.ndarray, k: int) -> np.ndarray:
    """Phase one: of each query the k-th best exact score among the k best of each node; NONE with fewer than k."""
    out = np.full(len(qi), NONE)
    if len(ci) < k:
        return out
    for i, j in _steps(qi, len(ci)):
        other = qi[i:j, None] != ci[None]
        tops = []
        for n in _nodes(qv.shape[1]):
            s = np.where(other, _products(qv[i:j, n], cv[:, n]), NONE).astype(float)
            tops.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
        at = np.sort(np.concatenate(tops, axis=1), axis=1)
        exact = np.einsum("qtw,qw->qt", cv[at], qv[i:j])
        # A candidate that several nodes name counts once, and the query's own row not at all.
        ok = np.take_along_axis(other, at, axis=1)
        ok[:, 1:] &= at[:, 1:] != at[:, :-1]
        exact = np.sort(np.where(ok, exact, NONE), axis=1)[:, ::-1]
        out[i:j] = exact[:, k - 1]
    return out


def sufficient(qi: np.ndarray, qv: np.ndarray, ci: np.ndarray, cv: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase two: (query, candidate) index pairs that the cutoffs leave."""
    known = (cut > NONE)[:, None]
    cut = np.where(cut > NONE, cut, 0).astype(float)[:, None]
    nodes = _nodes(qv.shape[1])
    share = cut / len(nodes)
    other = qi[:, None] != ci[None]
    most, seen = np.zeros(other.shape), np.zeros(other.shape, bool)
    for n in nodes:
        s = _products(qv[:, n], cv[:, n]).astype(float)
        seen |= s >= share
        most += np.maximum(s, share)
    # A margin far above what rounding may take.
    left = seen & (most >= cut - 1e-6 * np.abs(cut) - 1)
    return np.nonzero(other & (left | ~known))


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of entries by ascending query the indices of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def searched(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among all rows of other ids.

    Components x become floor(scale * x) with x as double. Vectors (or ids) that are null or hold null, NaN or infinite
    components take no part; shorter vectors count as padded with zeros. Fewer than k others give all; equal scores rank
    by smaller vec_id. Every row is a candidate of its own, so an id in several rows may stand at several ranks; a query
    id with several vectors is as many queries, each ranked from 1, and equal rows are one query.
    """
    v = pruned(vectors, id_col, vec_col).toDF("vec_id", "e").where("vec_id is not null and e is not null")
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = written(v.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v")), "integers")
    width = v.agg(F.max(F.size("v"))).first()[0] or 1
    c = written(packs(v, width), "candidates")
    q = written(packs(v.where(queries).dropDuplicates(["vec_id", "v"]), width), "queries")
    blocks, slices = (max(1, -(-x.count() // n)) for x, n in ((c, BLOCK), (q, SLICE)))
    block, slice_ = (F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int") for n in (blocks, slices))
    c, q = c.withColumn("block", block), q.withColumn("slice", slice_)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["block", "slice"]

    def gather(near: pa.Table, asked: pa.Table) -> pa.Table:
        ci, cv = _opened(near, width)
        out = []
        for i in range(asked.num_rows):
            qi, qv = (np.frombuffer(asked["ids"][i].as_py(), np.int64), np.frombuffer(asked["v"][i].as_py(), asked["kind"][i].as_py()).reshape(-1, width).astype(np.int64))
            out.append(cutoffs(qi, qv, ci, cv, k).tobytes())
        return pa.table({"pack": asked["pack"], "cuts": pa.array(out, pa.binary())})

    # Each slice meets one block; the cutoffs go with their packs of queries, never as a whole.
    home = F.pmod(F.col("slice"), F.lit(blocks)).cast("int")
    at_home = c.withColumn("slice", every(slices)).where(F.col("block") == home)
    cuts = at_home.groupBy(pair).cogroup(q.withColumn("block", home).groupBy(pair)).applyInArrow(gather, "pack long, cuts binary")
    armed = q.join(written(cuts, "cutoffs"), "pack")

    def resolve(near: pa.Table, asked: pa.Table) -> pa.Table:
        ci, cv = _opened(near, width)
        cols = [[], [], [], []]
        for row in asked.to_pylist():
            qi, qv = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], row["kind"]).reshape(-1, width).astype(np.int64)
            cut = np.frombuffer(row["cuts"], np.int64)
            for i, j in _steps(qi, len(ci)):
                a, b = sufficient(qi[i:j], qv[i:j], ci, cv, cut[i:j])
                for x in range(0, max(1, len(a)), CELLS // width + 1):
                    p, r = a[x : x + CELLS // width + 1], b[x : x + CELLS // width + 1]
                    s = np.einsum("pw,pw->p", qv[i + p], cv[r])
                    keep = best(p, ci[r], s, k)
                    for col, y in zip(cols, (np.full(len(keep), row["pack"]), i + p[keep], ci[r[keep]], s[keep])):
                        col.append(y)
        pack, place, ids, score = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in cols)
        _, query = np.unique(np.stack([pack, place]), axis=1, return_inverse=True)
        keep = best(query.reshape(-1), ids, score, k)
        place_id = {r["pack"]: np.frombuffer(r["ids"], np.int64) for r in asked.select(["pack", "ids"]).to_pylist()}
        query = np.array([place_id[x][y] for x, y in zip(pack[keep].tolist(), place[keep].tolist())], np.int64)
        return pa.table({"pack": pack[keep], "place": place[keep], "query_id": query, "vec_id": ids[keep], "score": score[keep]})

    found = c.withColumn("slice", every(slices)).groupBy(pair).cogroup(armed.withColumn("block", every(blocks)).groupBy(pair))
    found = found.applyInArrow(resolve, "pack long, place long, query_id long, vec_id long, score long")
    # Ranked among at most k rows of each block; ranks beyond k are dropped before the shuffle as well.
    rank = F.row_number().over(Window.partitionBy("pack", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Centroid clustering in integers, on distinct vectors with multiplicities.

Vectors are quantised, identical ones become one row with a weight, and Lloyd's rounds run on these rows alone: each task
adds up weighted sums by cluster, so a round sends clusters times dimensions numbers from a task, whatever its rows. All
sums are of integers and hence the same in any order. At the end the vectors get the cluster of their distinct row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.shared import classed, pruned, written

#: Quantised components lie within this bound, so that no distance leaves 64 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) as longs) of the vectors of exactly `dims` components, none null or non-finite."""
    v = pruned(vectors, id_col, vector_col).toDF("vec_id", "v")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = lambda x: F.floor(x.cast("double") * scale)
    small = F.forall("v", lambda x: (x.cast("double") * scale >= -LARGEST) & (x.cast("double") * scale < LARGEST))
    checked = F.when(small, F.transform("v", whole)).otherwise(F.raise_error(F.lit(f"a quantised component lies beyond {LARGEST}")))
    # One expression, as Spark may move a projection before a filter.
    return v.select("vec_id", F.when((F.size("v") == dims) & fine, checked).cast("array<long>").alias("v")).where("v is not null")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of x; ties go to the smaller number."""
    best, least = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        best, least = np.where(d < least, np.int32(k), best), np.minimum(d, least)
    return best, least


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` components, none null or non-finite. The first centroids are those of the
    smallest sha256 of `seed:vec_id` (rows of one id in order of their vectors, null ids last); with fewer vectors there
    are fewer, without any no rows. An empty cluster keeps its centroid. Repeated rows are vectors each for itself, and
    weigh so. A quantised component beyond 2**27, whose distances would leave 64 bits, is an error.
    """
    q = quantised(vectors, id_col, vector_col, dims, scale)
    distinct = written(q.groupBy("v").agg(F.count("*").alias("n")).select(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256).alias("key"), "v", "n"), "distinct")
    first = q.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    centroids = np.array([r.v for r in first.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64).reshape(-1, dims)

    def sums(batches):
        total, n = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x, w = _matrix(b.column(0), dims), b.column(1).to_numpy()
            at, _ = nearest(x, centroids)
            for c in range(len(centroids)):
                total[c] += w[at == c] @ x[at == c]
                n[c] += w[at == c].sum()
        cluster, dim = np.divmod(np.arange(total.size, dtype=np.int32), np.int32(dims))
        full = n[cluster] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[full]) for a in (cluster, dim, total.ravel(), n[cluster])], ["cluster", "dim", "total", "n"])

    for _ in range(rounds if len(centroids) else 0):
        parts = distinct.select("v", "n").mapInArrow(sums, "cluster int, dim int, total long, n long")
        # k * dims rows.
        moved = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        new = centroids.copy()
        for r in moved:
            new[r.cluster, r.dim] = int(r.total) // r.n
        if np.array_equal(new, centroids):
            break  # further rounds would change nothing
        centroids = new

    def assigned(batches):
        for b in batches:
            at, d = nearest(_matrix(b.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["key", "n", "cluster", "distance"])

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    found = written(distinct.select("key", "v", "n").mapInArrow(assigned, "key string, n long, cluster int, distance long"), "assigned")
    # At most k rows.
    per = {r.cluster: (r.s, r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}
    own = F.get(F.array(*[F.lit(per.get(c, (0, 0))[0]).cast("long") for c in range(len(names))] or [F.lit(0).cast("long")]), F.col("cluster"))
    sha = F.get(F.array(*[F.lit(x) for x in names] or [F.lit("")]), F.col("cluster"))
    keyed = q.select("vec_id", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256).alias("key"))
    out = classed(keyed, found, "key", sum(n for _, n in per.values()))
    return out.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(s for s, _ in per.values())).cast("long").alias("inertia"), sha.alias("centroid_sha256"))


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, round by round."""
    parts = [
        f"""
q AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, v FROM q
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS w FROM q
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k}
)"""
    ]
    square = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT id, vec_id, v, c, {square} AS s FROM d, c{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, c) = 1)")
        if r < rounds:
            parts.append(
                f"""u{r} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS w FROM (
    SELECT c, i, ((sum(v[i]) - (sum(v[i]) % count(*) + count(*)) % count(*)) // count(*))::bigint AS m FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c, coalesce(u.w, o.w) AS w FROM c{r} o LEFT JOIN u{r} u USING (c))"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::int AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::bigint AS cluster_inertia,
       (sum(s) OVER ())::bigint AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""

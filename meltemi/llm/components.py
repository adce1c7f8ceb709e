"""Connected components: tasks contract their edges, stars join what they leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.shared import written

#: Edges that a task contracts at once, some 100 MB there.
CHUNK = 1_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges from every node to the smallest one that these edges reach."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(ids)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        # The smaller number stands for the smaller id, so roots are least.
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    root = np.array(parent, np.int64)
    while len(root) and not np.array_equal(root, root[root]):
        root = root[root]
    out = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(ids[out], pa.int64()), pa.array(ids[root[out]], pa.int64())], ["u", "v"])


def _contracted(batches, chunk, ordered):
    """Edges (u, v) of a task as forests of about `chunk` edges each; where they come in order of u, no u's edges are parted."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= chunk:
            u, v = map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(u, u[-1])) if ordered else size
            if cut:
                yield _forest(u[:cut], v[:cut])
            held, size = [(u[cut:], v[cut:])], size - cut
    if size:
        yield _forest(*map(np.concatenate, zip(*held)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v) of type long; component is its smallest node.

    Each turn hooks the larger end of each edge to the smallest neighbour of the other, and tasks that hold all edges of
    a larger end contract them; there are about as many turns as the logarithm of the largest component, fewer where
    tasks see much of it. The turns end with stars. One number a turn comes to the driver; as its memory also holds what
    Spark keeps of each task, a turn has few shuffles: edges twice, nodes twice at most. A forest has one edge from a
    node at most, so that no larger end is hot; smaller ones meet in a join, which Spark can split.
    """
    chunk = CHUNK

    def contracted(e, ordered):
        return written(e.mapInArrow(lambda batches: _contracted(batches, chunk, ordered), "u long, v long"), "edges")

    e = contracted(edges.select("u", "v").where("u <> v"), False)
    while True:
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select("v", "u", F.lit(0), F.lit(1)))
        near = ends.groupBy("node").agg(F.min("other").alias("m"), F.sum("up").alias("up"), F.max("down").alias("down"))
        near = written(near.select("node", F.least("node", "m").alias("m"), "up", "down"), "near")
        # Stars: whatever has an edge to a smaller node has that one alone.
        if not near.where("up > 1 or up = 1 and down = 1").count():
            break
        hooked = e.join(near.select(F.col("node").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        e = contracted(hooked.repartition("u").sortWithinPartitions("u"), True)
    return near.select("node", F.col("m").alias("component"))

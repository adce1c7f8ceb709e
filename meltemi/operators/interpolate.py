"""Patches of grid cells around targets, and the weights of a C1 cubic surface over them.

A field of any number of time steps is interpolated by one join: value = sum(weight * cell value). The weights depend on
the geometry of a patch alone, so targets that share a patch share its triangulation and gradients.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.operators.spatial import by_place, gradients, nearest_cells
from meltemi.scratch import written


def _scaled(df: DataFrame, key: str, scale: float) -> DataFrame:
    return df.select(key, (F.col("lon") * scale).alias("x"), F.col("lat").alias("y"))


def _scale(grid: DataFrame) -> float:
    """Degrees of longitude in degrees of latitude at the grid's mean latitude."""
    return float(np.cos(np.radians(grid.agg(F.avg("lat")).first()[0] or 0.0)))


def patches(targets: DataFrame, grid: DataFrame, land: bool = True, side: int = 4, k: int = 16, least: int = 4, candidates: int = 8000) -> DataFrame:
    """(target_id, cell_id) of the cells that a target is interpolated from.

    targets: target_id, lon, lat; grid: cell_id, x, y (its column and row from 0), lon, lat, is_land. Where the nearest
    cell is land, or with land=False, a block of side x side cells from two before it on, cut off at the grid's border.
    Elsewhere the k nearest land cells among the `candidates` nearest cells; fewer than `least` are an error. Targets of
    one place share its patch.
    """
    return by_place(targets.select("target_id", "lon", "lat"), "target_id", ["lon", "lat"], lambda t: _patches(t, grid, land, side, k, least, candidates))


def _among(ranked: DataFrame, places: DataFrame, cells: DataFrame, candidates: int) -> DataFrame:
    """ranked (target_id, cell_id, d2) without those that aren't among the `candidates` nearest cells of their target.

    Counts of cells by bucket of a square grid tell the many targets around whose farthest row lie no more cells than
    that. For the others, and for those whose square is as many buckets, the nearest cells are told one by one.
    """
    a = cells.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide, high = (max(v, 1e-9) for v in (a[2] - a[1], a[4] - a[3]))
    # About eight cells a bucket.
    size = max(math.sqrt(wide * high * 8 / a[0]), max(wide, high) * 8 / a[0])
    at = lambda c: F.floor(c / size).cast("long")
    counts = cells.groupBy(at(F.col("x")).alias("bx"), at(F.col("y")).alias("by")).agg(F.count("*").alias("n"))
    # Ranks are by rounded distances.
    far = ranked.groupBy("target_id").agg(F.sqrt(F.max("d2") + 2e-9).alias("r"))
    lo = {c: math.floor(v / size) for c, v in (("x", a[1]), ("y", a[3]))}
    hi = {c: math.floor(v / size) for c, v in (("x", a[2]), ("y", a[4]))}
    box = places.join(far, "target_id")
    for c in "xy":
        box = box.withColumns({f"{c}0": F.greatest(at(F.col(c) - F.col("r")), F.lit(lo[c])), f"{c}1": F.least(at(F.col(c) + F.col("r")), F.lit(hi[c]))})
    small = box.where((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= candidates)
    small = small.withColumn("bx", F.explode(F.sequence("x0", "x1"))).withColumn("by", F.explode(F.sequence("y0", "y1")))
    sure = written(small.join(counts, ["bx", "by"]).groupBy("target_id").agg(F.sum("n").alias("n")).where(F.col("n") <= candidates).select("target_id"), "sure")
    rest = places.join(far.select("target_id"), "target_id", "left_semi").join(sure, "target_id", "left_anti")
    if rest.isEmpty():
        return ranked
    within = nearest_cells(rest, cells, candidates)
    return ranked.join(sure, "target_id", "left_semi").unionByName(ranked.join(within.select("target_id", "cell_id"), ["target_id", "cell_id"], "left_semi").select(*ranked.columns))


def _patches(targets: DataFrame, grid: DataFrame, land: bool, side: int, k: int, least: int, candidates: int) -> DataFrame:
    scale = _scale(grid)
    t = _scaled(targets, "target_id", scale)
    near = nearest_cells(t, _scaled(grid, "cell_id", scale)).join(grid.select("cell_id", "x", "y", "is_land"), "cell_id")
    near = written(near.select("target_id", "x", "y", "is_land"), "nearest")
    block = near.where(F.col("is_land")) if land else near
    first = {c: F.greatest(F.col(c) - side // 2, F.lit(0)) for c in "xy"}
    for c in "xy":
        block = block.withColumn(c, F.explode(F.sequence(first[c], first[c] + side - 1)))
    out = block.select("target_id", "x", "y").join(grid.select("cell_id", "x", "y"), ["x", "y"]).select("target_id", "cell_id")
    if not land:
        return out
    sea = near.where(~F.coalesce("is_land", F.lit(False))).select("target_id")
    asked = t.join(sea, "target_id", "left_semi")
    # Few land cells lie so far that `candidates` cells are nearer, so these are told apart only for targets that need it.
    ranked = nearest_cells(asked, _scaled(grid.where("is_land"), "cell_id", scale), k)
    if grid.count() > candidates:
        ranked = _among(written(ranked, "land"), asked, _scaled(grid, "cell_id", scale), candidates)
    counts = sea.join(ranked.groupBy("target_id").agg(F.count("*").alias("n")), "target_id", "left")
    enough = F.when(F.coalesce("n", F.lit(0)) >= least, F.col("target_id")).otherwise(F.raise_error(F.concat(F.lit("too few land cells near target "), F.col("target_id").cast("string"))))
    checked = counts.select(enough.cast(t.schema["target_id"].dataType).alias("target_id"))
    return out.unionByName(checked.join(ranked.select("target_id", "cell_id"), "target_id", "left"))


def nearest_land(targets: DataFrame, grid: DataFrame, candidates: int = 500) -> DataFrame:
    """(target_id, cell_id): the nearest cell; where that is sea, the nearest land among the `candidates` nearest, if any."""
    return by_place(targets.select("target_id", "lon", "lat"), "target_id", ["lon", "lat"], lambda t: _nearest_land(t, grid, candidates))


def _nearest_land(targets: DataFrame, grid: DataFrame, candidates: int) -> DataFrame:
    scale = _scale(grid)
    t, kinds = _scaled(targets, "target_id", scale), grid.select("cell_id", "is_land")
    near = nearest_cells(t, _scaled(grid, "cell_id", scale)).join(kinds, "cell_id").select("target_id", "cell_id", "is_land")
    near = written(near, "nearest")
    sea = near.where(~F.coalesce("is_land", F.lit(False)))
    around = nearest_cells(t.join(sea, "target_id", "left_semi"), _scaled(grid, "cell_id", scale), candidates)
    first = around.join(kinds.where("is_land"), "cell_id").groupBy("target_id").agg(F.min_by("cell_id", "rank").alias("land_id"))
    return near.join(first, "target_id", "left").select("target_id", F.coalesce("land_id", "cell_id").alias("cell_id"))


def static_terrain(grid: DataFrame, value: str = "v", dx: float = 1.0, dy: float = 1.0, side: int = 4) -> DataFrame:
    """(cell_id, elev_m, northness, eastness): means over the block that patches() takes around each cell.

    grid: cell_id, x, y (rows northwards), value; dx and dy are a cell's width and height. The aspect of a cell is the
    direction in which it rises, clockwise from north, from centred differences.
    """
    turn = F.atan2(F.col("gx") / dx, F.col("gy") / dy)
    cells = gradients(grid, value).select("cell_id", "x", "y", F.col(value).alias("v"), F.cos(turn).alias("n"), F.sin(turn).alias("e"))
    # A cell belongs to the blocks that begin up to `side` cells before it; the first block begins at the border.
    own = cells.select("cell_id", *[F.greatest(F.col(c) - side // 2, F.lit(0)).alias(f"{c}0") for c in "xy"])
    at = cells
    for c in "xy":
        at = at.withColumn(f"{c}0", F.explode(F.sequence(F.greatest(F.col(c) - side + 1, F.lit(0)), F.col(c))))
    means = at.groupBy("x0", "y0").agg(F.avg("v").alias("elev_m"), F.avg("n").alias("northness"), F.avg("e").alias("eastness"))
    return own.join(means, ["x0", "y0"]).drop("x0", "y0")


def triangulated(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three indices) of a few points: the faces below the points lifted to x2 + y2.

    Four points of one circle, as on a regular grid, allow either diagonal; heights changed by a billionth decide, the
    same way for the same order of points.
    """
    p = xy - xy.mean(0)
    p = p / max(1e-300, np.abs(p).max())
    z = (p**2).sum(1) + 1e-9 * (1e4 * np.sin(np.arange(1.0, len(p) + 1)) % 1.0)
    t = np.array(list(itertools.combinations(range(len(p)), 3)), np.int64).reshape(-1, 3)
    a, u, v = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    area = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    t, a, u, v, area = (m[np.abs(area) > 1e-10] for m in (t, a, u, v, area))
    zu, zv = z[t[:, 1]] - z[t[:, 0]], z[t[:, 2]] - z[t[:, 0]]
    gx, gy = (zu * v[:, 1] - zv * u[:, 1]) / area, (zv * u[:, 0] - zu * v[:, 0]) / area
    above = z[None] - z[t[:, 0], None] - gx[:, None] * (p[None, :, 0] - a[:, :1]) - gy[:, None] * (p[None, :, 1] - a[:, 1:])
    above[np.arange(len(t))[:, None], t] = 0.0
    return t[(above >= -1e-13).all(1)]


def gradients_by_value(xy: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """G[i, c] with gradient of point i, component c = G[i, c] @ values: the one of least curvature along all edges.

    Along an edge of length L the surface is the cubic of its end values and slopes, whose squared second derivative
    integrates to 4 (a2 + ab + b2 - 3 d (a + b) + 3 d2) / L3 for slopes a, b along the edge and difference d.
    """
    n = len(xy)
    lhs, rhs = np.zeros((n, 2, n, 2)), np.zeros((n, 2, n))
    for i, j in {tuple(sorted(e)) for t in triangles.tolist() for e in itertools.combinations(t, 2)}:
        e = xy[j] - xy[i]
        weight = 1.0 / np.hypot(*e) ** 3
        square = weight * np.outer(e, e)
        for a, b in ((i, j), (j, i)):
            lhs[a, :, a] += 2 * square
            lhs[a, :, b] += square
            rhs[a, :, j] += 3 * weight * e
            rhs[a, :, i] -= 3 * weight * e
    free = sorted({i for t in triangles.tolist() for i in t})
    out = np.zeros((n, 2, n))
    m = lhs[free][:, :, free].reshape(2 * len(free), -1)
    out[free] = np.linalg.solve(m, rhs[free].reshape(2 * len(free), n)).reshape(len(free), 2, n)
    return out


class Surface:
    """The C1 cubic over a patch: each triangle is split at its centre into three cubics (Clough and Tocher).

    The slope across an edge, taken towards the centre of the triangle beyond it, is linear along the edge; at the
    border it is taken towards the edge's middle.
    """

    def __init__(self, xy: np.ndarray):
        self.xy = xy
        self.triangles = triangulated(xy) if len(xy) >= 3 else np.zeros((0, 3), np.int64)
        if len(self.triangles):
            self.gradients = gradients_by_value(xy, self.triangles)
            corners = xy[self.triangles].transpose(0, 2, 1)
            self.shares = np.linalg.inv(np.concatenate([corners, np.ones((len(corners), 1, 3))], axis=1))
            self.edges: dict = {}
            for k, t in enumerate(self.triangles.tolist()):
                for e in itertools.combinations(sorted(t), 2):
                    self.edges.setdefault(e, []).append(k)

    def weights(self, at: np.ndarray) -> np.ndarray | None:
        """The weight of each point's value at a place, None outside the hull."""
        if not len(self.triangles):
            return None
        b = self.shares @ np.array([*at, 1.0])
        inside = b.min(1) >= -1e-9
        if not inside.any():
            return None
        k = int(np.argmax(inside))
        t = self.triangles[k].tolist()
        return self._cubic(k, t, self.xy[t], np.clip(b[k], 0.0, 1.0))

    def _cubic(self, k: int, t: list[int], v: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, centre = len(self.xy), v.mean(0)
        f = np.eye(n)[t]
        # Control values, each as weights of the points' values: from corner i towards j, and towards the centre.
        toward = lambda i, p: f[i] + (p - v[i]) @ self.gradients[t[i]] / 3.0
        side = {(i, j): toward(i, v[j]) for i in range(3) for j in range(3) if i != j}
        inner = [toward(i, centre) for i in range(3)]
        middle = {}
        for i, j in ((0, 1), (1, 2), (2, 0)):
            beyond = [x for x in self.edges[tuple(sorted((t[i], t[j])))] if x != k]
            part = 0.5
            if beyond:
                other = self.xy[self.triangles[beyond[0]]].mean(0)
                w = np.linalg.solve(np.vstack([np.column_stack([v[i], v[j], centre]), np.ones(3)]), np.array([*other, 1.0]))
                part = w[1] / (1.0 - w[2])
            # Slopes across at both ends, in the direction from the place `part` on the edge to the centre.
            first = -(1 - part) * f[i] - part * side[i, j] + inner[i]
            last = -(1 - part) * side[j, i] - part * f[j] + inner[j]
            middle[i, j] = (first + last) / 2.0 + (1 - part) * side[i, j] + part * side[j, i]
        deep = [(inner[i] + sum(m for e, m in middle.items() if i in e)) / 3.0 for i in range(3)]
        low = int(np.argmin(b))
        i, j = [x for x in range(3) if x != low]
        c = 3.0 * b[low]
        p, q = b[i] - b[low], b[j] - b[low]
        m = middle[i, j] if (i, j) in middle else middle[j, i]
        return (
            p**3 * f[i] + q**3 * f[j] + 3 * p * p * q * side[i, j] + 3 * p * q * q * side[j, i]
            + 3 * p * p * c * inner[i] + 3 * q * q * c * inner[j] + 6 * p * q * c * m
            + 3 * p * c * c * deep[i] + 3 * q * c * c * deep[j] + c**3 * sum(deep) / 3.0
        )


@lru_cache(maxsize=4096)
def _surface(coordinates: bytes) -> Surface:
    return Surface(np.frombuffer(coordinates).reshape(-1, 2))


def cubic_weights(patches: DataFrame, targets: DataFrame, grid: DataFrame) -> DataFrame:
    """(target_id, cell_id, weight) of the C1 cubic through a target's patch, to be applied as sum(weight * value).

    Outside the hull of a patch, or where all its cells lie on one line, the nearest cell has all the weight; there
    longitudes count by the cosine of the target's latitude. A patch is a few cells, so a task holds one target at a time.
    """
    cell = F.struct("cell_id", "lat", "lon")
    lists = patches.join(grid.select("cell_id", "lat", "lon"), "cell_id").groupBy("target_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    rows = lists.join(targets.select("target_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")), "target_id")

    def run(batches):
        for b in batches:
            who, ids, weights = [], [], []
            for t, cells, lat, lon in zip(*(b.column(c).to_pylist() for c in ("target_id", "cells", "tlat", "tlon"))):
                xy = np.array([[c["lat"], c["lon"]] for c in cells], float)
                w = _surface(xy.tobytes()).weights(np.array([lat, lon]))
                if w is None:
                    w = np.zeros(len(xy))
                    w[np.argmin(np.hypot(xy[:, 0] - lat, (xy[:, 1] - lon) * np.cos(np.radians(lat))))] = 1.0
                who += [t] * len(cells)
                ids += [c["cell_id"] for c in cells]
                weights.append(w)
            cols = [pa.array(who, b.schema.field("target_id").type), pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0), *weights]))]
            yield pa.RecordBatch.from_arrays(cols, ["target_id", "cell_id", "weight"])

    return rows.mapInArrow(run, f"target_id {rows.schema['target_id'].dataType.simpleString()}, cell_id long, weight double")


def interpolated(weights: DataFrame, series: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """series (cell_id, by, values) at the targets; a missing value in a cell that counts gives null.

    The pieces of a sum that only some cells have would shift the surface, hence null.
    """
    full = lambda c: F.when(F.bool_and(F.col(c).isNotNull() | (F.col("weight") == 0)), F.sum(F.col("weight") * F.col(c)))
    return weights.join(series, "cell_id").groupBy("target_id", *by).agg(*[full(c).alias(c) for c in values])

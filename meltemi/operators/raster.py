"""Terrain of rasters of any size: tiles with margins, sampling at points, clipping to polygons.

Each cell goes to its tile and to those whose margin it lies in; a task holds one tile with a margin as wide as what a
cell looks at. Rasters have rows that grow southwards, as images do, unless stated otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a place without elevation gets.
NEUTRAL = {"dem_northness": 0.0, "dem_eastness": 0.0, "dem_slope_deg": 0.0, "tpi_500": 0.0, "tpi_2000": 0.0, "svf": 1.0}


def _tiled(cells: DataFrame, tile: int, margin: int) -> DataFrame:
    """cells with the tiles (tx, ty) that need them."""
    for c, t in (("x", "tx"), ("y", "ty")):
        first, last = F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)
        cells = cells.withColumn(t, F.explode(F.sequence(first, last)))
    return cells


def _disk_sum(sums: np.ndarray, i: np.ndarray, j: np.ndarray, ky: int, widths: list[int]) -> np.ndarray:
    """Sums over the disk around each (i, j), row by row of it, from sums along the rows."""
    out = np.zeros(len(i))
    for dy, w in zip(range(-ky, ky + 1), widths):
        out += sums[i + dy, j + w + 1] - sums[i + dy, j - w]
    return out


def _position(a: np.ndarray, i: np.ndarray, j: np.ndarray, radius: float, px: float, py: float) -> np.ndarray:
    """Height over the mean of the cells within the radius, the cell itself left out; 0 with fewer than four."""
    ky = int(radius / py)
    across = np.arange(int(radius / px) + 1) * px
    widths = [int(np.flatnonzero(np.hypot(across, dy * py) <= radius)[-1]) for dy in range(-ky, ky + 1)]
    known = np.isfinite(a)
    centre = a[i, j]
    # Heights over the tile's mean keep the sums small.
    level = a[known].mean() if known.any() else 0.0
    along = lambda m: np.concatenate([np.zeros((len(m), 1)), np.cumsum(m, axis=1)], axis=1)
    n = _disk_sum(along(known.astype(float)), i, j, ky, widths) - 1
    total = _disk_sum(along(np.where(known, a - level, 0.0)), i, j, ky, widths) - (centre - level)
    return np.where(n >= 4, centre - level - total / np.maximum(n, 1), 0.0)


def _sky(a: np.ndarray, i: np.ndarray, j: np.ndarray, directions: int, far: int, px: float, py: float) -> np.ndarray:
    """1 less the mean squared sine of the highest angle in each direction, up to `far` cells away."""
    covered = np.zeros(len(i))
    for q in range(directions):
        turn, top = 2 * math.pi * q / directions, np.zeros(len(i))
        for k in range(1, far + 1):
            di, dj = round(-math.cos(turn) * k), round(math.sin(turn) * k)
            rise = (a[i + di, j + dj] - a[i, j]) / math.hypot(di * py, dj * px)
            top = np.fmax(top, rise)
        covered += np.sin(np.arctan(top)) ** 2
    return np.maximum(0.0, 1.0 - covered / directions)


def _slope(a: np.ndarray, i: np.ndarray, j: np.ndarray, px: float, py: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(northness, eastness, slope in degrees) of the rise over 3 x 3 cells; zeros where one of them is missing."""
    row = lambda d: (a[i + d, j - 1] + a[i + d, j] + a[i + d, j + 1]) / 3
    column = lambda d: (a[i - 1, j + d] + a[i, j + d] + a[i + 1, j + d]) / 3
    north, east = -((row(1) - row(-1)) / (2 * py)), (column(1) - column(-1)) / (2 * px)
    whole = np.isfinite(north + east + a[i, j])
    turn = np.arctan2(east, north)
    return tuple(np.where(whole, v, 0.0) for v in (np.cos(turn), np.sin(turn), np.degrees(np.arctan(np.hypot(east, north)))))


def terrain(points: DataFrame, grid: DataFrame, value: str = "v", x: str = "x", y: str = "y", px: float = 250.0, py: float = 250.0, radii=(500.0, 2000.0), directions: int = 16, far: int = 150, tile: int | None = None) -> DataFrame:
    """points (id, x, y) with dem_northness, dem_eastness, dem_slope_deg, tpi_<radius> for each radius, and svf.

    grid: x and y (column and row), value; missing rows and null values have no height. Points outside and on cells
    without height get NEUTRAL values; repeated points and cells asked for often are worked out once. radii in the unit
    of px and py. No points: no rows; an empty grid: neutral values.
    """
    margin = max([far if directions else 1, 1, *[max(math.ceil(r / px), math.ceil(r / py)) for r in radii]])
    tile = tile or max(64, 2 * margin)
    names = ["dem_northness", "dem_eastness", "dem_slope_deg", *[f"tpi_{int(r)}" for r in radii], *(["svf"] if directions else [])]
    cells = grid.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(value).cast("double").alias("v"))
    cells = cells.where("v is not null and not isnan(v)")
    asked = points.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).where("x is not null and y is not null").distinct()
    asked = asked.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))

    def run(key, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * tile - margin, int(key[1]) * tile - margin
        a = np.full((tile + 2 * margin, tile + 2 * margin), np.nan)
        a[have["y"].to_numpy() - y0, have["x"].to_numpy() - x0] = have["v"].to_numpy()
        i, j = want["y"].to_numpy() - y0, want["x"].to_numpy() - x0
        known = np.isfinite(a[i, j])
        out = want[["x", "y"]][known].copy()
        i, j = i[known], j[known]
        out["dem_northness"], out["dem_eastness"], out["dem_slope_deg"] = _slope(a, i, j, px, py)
        for r in radii:
            out[f"tpi_{int(r)}"] = _position(a, i, j, r, px, py)
        if directions:
            out["svf"] = _sky(a, i, j, directions, far, px, py)
        return out

    schema = "x long, y long, " + ", ".join(f"{n} double" for n in names)
    found = asked.groupBy("tx", "ty").cogroup(_tiled(cells, tile, margin).groupBy("tx", "ty")).applyInPandas(run, schema)
    at = (F.col(x).cast("long") == F.col("_x")) & (F.col(y).cast("long") == F.col("_y"))
    out = points.join(found.withColumnsRenamed({"x": "_x", "y": "_y"}), at, "left").drop("_x", "_y")
    return out.withColumns({n: F.coalesce(n, F.lit(1.0 if n == "svf" else 0.0)) for n in names})


def pixel(lon: Column, lat: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(column, row) of the pixel at a place, by the affine transform (a, b, c, d, e, f): lon = a col + b row + c, lat = d col + e row + f.

    Rounded to the nearest number, halves to the even one.
    """
    a, b, c, d, e, f = transform
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    column, row = (e * (lon - c) - b * (lat - f)) / det, (a * (lat - f) - d * (lon - c)) / det
    return F.rint(column).cast("long"), F.rint(row).cast("long")


def sampled(points: DataFrame, dem: DataFrame, transform: tuple[float, float, float, float, float, float], px: float, py: float, **options) -> DataFrame:
    """points (id, lon, lat) with the terrain features of the pixel that each lies on; neutral values off the raster."""
    col, row = pixel(F.col("lon"), F.col("lat"), transform)
    at = points.select("id", col.alias("x"), row.alias("y"))
    found = terrain(at, dem, px=px, py=py, **options).drop("x", "y")
    return points.join(found, "id", "left")


def pixel_metres(transform: tuple[float, float, float, float, float, float], rows: int) -> tuple[float, float]:
    """(px, py): the size of a pixel in metres at the middle row of a raster of so many rows."""
    middle = transform[5] + transform[4] * rows / 2
    return abs(transform[0]) * 111_320.0 * math.cos(math.radians(abs(middle))), abs(transform[4]) * 111_320.0


def clipped(dem: DataFrame, edges: DataFrame, transform: tuple[float, float, float, float, float, float], floor: float = 0.0) -> DataFrame:
    """The cells (x, y, v) of a raster whose centres lie in a polygon, heights below `floor` raised to it.

    edges: polygon, x1, y1, x2, y2 in lon and lat. The transform is without rotation. Each raster row is crossed by some
    edges; between the first and the second crossing, the third and the fourth, and so on, it lies inside. Rows and
    edges meet by an explode of the rows that an edge spans, and cells and stretches by row and block of columns.
    """
    a, b, c, d, e, f = transform
    if b or d:
        raise ValueError("the raster is rotated")
    edge = edges.select("polygon", *[((F.col(n) - o) / s - 0.5).alias(n) for n, o, s in (("x1", c, a), ("y1", f, e), ("x2", c, a), ("y2", f, e))])
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Rows y with lo <= y < hi: an edge holds its upper end and not its lower one, so a corner counts once.
    edge = edge.where(F.ceil(lo) < hi).withColumn("y", F.explode(F.sequence(F.ceil(lo), F.ceil(hi) - 1)))
    crossing = F.col("x1") + (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1"))
    # The crossings of one polygon with one row.
    lines = edge.groupBy("polygon", "y").agg(F.sort_array(F.collect_list(crossing)).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda k: F.struct(F.get("at", k).alias("lo"), F.get("at", k + 1).alias("hi")))
    parts = lines.where(F.size("at") >= 2).select("y", F.explode(pairs).alias("p")).select("y", "p.*").where(F.ceil("lo") < F.col("hi"))
    block = 256
    parts = parts.withColumn("bx", F.explode(F.sequence(F.floor(F.ceil("lo") / block), F.floor((F.ceil("hi") - 1) / block))))
    cells = dem.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v").withColumn("bx", F.floor(F.col("x") / block))
    inside = cells.alias("c").join(parts.alias("p"), (F.col("c.y") == F.col("p.y")) & (F.col("c.bx") == F.col("p.bx")) & (F.col("c.x") >= F.col("p.lo")) & (F.col("c.x") < F.col("p.hi")), "left_semi")
    return inside.select("x", "y", F.when(F.col("v").isNotNull(), F.greatest("v", F.lit(floor))).alias("v"))

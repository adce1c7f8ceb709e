"""Points in polygons and land masses, met through the cells of a square grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.scratch import written

#: Land masses below so many square kilometres are islands.
ISLAND_KM2 = 25_000.0


def _across(x: Column, y: Column, level: Column) -> Column:
    """Where an edge of (x1, y1), (x2, y2) meets the line on which y is the level; x and y may change places."""
    a, b = x
    c, d = y
    return a + (level - c) / F.nullif(d - c, F.lit(0.0)) * (b - a)


def contains(points: DataFrame, edges: DataFrame, cell_size: float | None = None) -> DataFrame:
    """(id, polygon): the first polygon (by its number) around each point; points (id, px, py), edges (polygon, x1, y1, x2, y2).

    Whether the middle of a cell lies inside a polygon is read off the crossings of the polygon with the cell's middle
    line, row by row. A point then is inside if the way to it from the middle of its cell, first up or down and then
    sideways, crosses edges an even number of times, or an odd number where the middle is outside; these edges lie in
    the cell. So each edge and each inner cell is met by equal keys alone. Polygons may overlap: of those that hold a
    whole cell the first alone counts there, and no later one's edges are looked at. Equal points are told once; points
    on an edge count to one side.
    """
    e = edges.select("polygon", "x1", "y1", "x2", "y2").where("polygon is not null and x1 + y1 + x2 + y2 is not null")
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    a = e.agg(F.count("*"), F.avg(size), *[f(g(f"{c}1", f"{c}2")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))]).first()
    empty = points.select("id").limit(0).join(e.select("polygon").limit(0))
    if not a[0]:
        return empty
    # About as many cells as edges, and few cells an edge.
    cell_size = cell_size or max(a[1] / 4, math.sqrt(max(a[3] - a[2], 1e-9) * max(a[5] - a[4], 1e-9) / a[0]), 1e-9)
    # Cells begin at an odd fraction, so that round coordinates don't lie on middle lines.
    x0, y0 = a[2] - 0.3819660112501051 * cell_size, a[4] - 0.2360679774997897 * cell_size
    at = lambda c, o: F.floor((c - o) / cell_size)
    middle = lambda b, o: (b + 0.5) * cell_size + o
    x, y = (F.col("x1"), F.col("x2")), (F.col("y1"), F.col("y2"))
    span = lambda c, o: F.sequence(at(F.least(*c), o), at(F.greatest(*c), o))
    rows = e.withColumn("by", F.explode(span(y, y0)))
    level = middle(F.col("by"), y0)
    crossed = rows.where((y[0] > level) != (y[1] > level)).select("polygon", "by", _across(x, y, level).alias("x"))
    order = Window.partitionBy("polygon", "by").orderBy("x")
    pairs = crossed.select("polygon", "by", "x", F.lead("x").over(order).alias("end"), F.row_number().over(order).alias("k")).where("k % 2 = 1 and end is not null")
    # Cells whose middle lies in [x, end).
    lo, hi = F.ceil((F.col("x") - x0) / cell_size - 0.5), F.ceil((F.col("end") - x0) / cell_size - 0.5) - 1
    inner = pairs.where(lo <= hi).select("polygon", "by", F.explode(F.sequence(lo, hi)).alias("bx"))
    # An edge's part within the row tells its cells there.
    end = lambda f, c: f(*[_across(x, y, F.greatest(F.least(*y), F.least(F.greatest(*y), F.col("by") * cell_size + y0 + s * cell_size))) for s in (0, 1)])
    flat = y[0] == y[1]
    left = F.when(flat, F.least(*x)).otherwise(end(F.least, x))
    right = F.when(flat, F.greatest(*x)).otherwise(end(F.greatest, x))
    slack = 1e-9 * cell_size
    held = rows.withColumn("bx", F.explode(F.sequence(at(left - slack, x0), at(right + slack, x0))))
    # No edge in the cell: all of it is inside, and later polygons can't be its points' first.
    keys = ["polygon", "by", "bx"]
    held = written(held, "edges")
    marked = inner.withColumn("_e", F.lit(0)).unionByName(held.select(*keys, F.lit(1).alias("_e"))).groupBy(*keys).agg(F.max("_e").alias("_e"), F.min("_e").alias("_i"))
    marked = written(marked.where("_i = 0"), "inner")
    full = written(marked.where("_e = 0").groupBy("by", "bx").agg(F.min("polygon").alias("first")), "full")
    before = lambda t: t.join(full, ["by", "bx"], "left").where("first is null or polygon < first").drop("first")
    held, inner = before(held), before(marked.where("_e = 1").select(*keys))
    p = points.select("px", "py").where("px is not null and py is not null").distinct().withColumn("bx", at(F.col("px"), x0)).withColumn("by", at(F.col("py"), y0))
    px, py, mx, my = F.col("px"), F.col("py"), middle(F.col("bx"), x0), middle(F.col("by"), y0)
    # Up or down on the cell's middle line, from my to py; a tie counts as if the line lay a little further right.
    v = _across(y, x, mx)
    beyond = lambda h: (h < v) | ((h == v) & ((y[1] - y[0]) * (x[1] - x[0]) > 0))
    up = ((x[0] > mx) != (x[1] > mx)) & (beyond(my) != beyond(py))
    # Sideways at the height of the point, from mx to px.
    h = _across(x, y, py)
    side = ((y[0] > py) != (y[1] > py)) & ((mx < h) != (px < h))
    met = p.join(held, ["bx", "by"]).select("px", "py", "polygon", (F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(side, F.lit(False)).cast("int")).alias("n"))
    both = met.unionByName(p.join(inner, ["bx", "by"]).select("px", "py", "polygon", F.lit(1).alias("n")))
    inside = both.groupBy("px", "py", "polygon").agg((F.sum("n") % 2).alias("odd")).where("odd = 1")
    inside = inside.select("px", "py", "polygon").unionByName(p.join(full, ["by", "bx"]).select("px", "py", F.col("first").alias("polygon")))
    first = inside.groupBy("px", "py").agg(F.min("polygon").alias("polygon"))
    return points.select("id", "px", "py").join(first, ["px", "py"]).select("id", "polygon")


def areas(edges: DataFrame) -> DataFrame:
    """(polygon, area) by the shoelace sum over each polygon's edges."""
    return edges.groupBy("polygon").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2.0).alias("area"))


def island(points: DataFrame, edges: DataFrame, limit_km2: float = ISLAND_KM2) -> DataFrame:
    """(id, polygon, is_island) of every point: whether its land mass is smaller than the limit; in none, null and false.

    Coordinates are metres of an equal-area projection.
    """
    at = contains(points, edges).join(areas(edges).select("polygon", (F.col("area") / 1e6 < limit_km2).alias("small")), "polygon")
    return points.select("id").join(at, "id", "left").select("id", "polygon", F.coalesce("small", F.lit(False)).alias("is_island"))

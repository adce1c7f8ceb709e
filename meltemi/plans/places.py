"""Nearest cells, coasts, terrain and raster indices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meltemi.functions.numeric import r6
from meltemi.operators import polygons
from meltemi.operators import spatial as sp
from meltemi.plans import roles
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


_COS = "cos(radians(38))"
_XY = f"t AS (SELECT id AS target_id, lon * {_COS} AS x, lat AS y FROM targets), c AS (SELECT cell_id, lon * {_COS} AS x, lat AS y FROM grid WHERE {{land}})"
_D2 = "(t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y)"


def _near(spark, d, k: int, land: bool):
    cos = F.cos(F.radians(F.lit(38.0)))
    t = roles.targets(spark, d).select(F.col("id").alias("target_id"), (F.col("lon") * cos).alias("x"), F.col("lat").alias("y"))
    g = roles.grid(spark, d)
    c = (g.where("is_land") if land else g).select("cell_id", (F.col("lon") * cos).alias("x"), F.col("lat").alias("y"))
    return sp.nearest_cells(t, c, k)


@query("j13_nearest_cell", _sql(roles.TARGETS, roles.GRID, _XY.format(land="true"), body=f"SELECT target_id, cell_id, round(d2, 6) AS d2 FROM (SELECT target_id, cell_id, {_D2} AS d2, row_number() OVER (PARTITION BY target_id ORDER BY round({_D2}, 9), cell_id) AS r FROM t, c) WHERE r = 1"))
def nearest(spark, d):
    return _near(spark, d, 1, False).select("target_id", "cell_id", r6(F.col("d2")).alias("d2"))


@query("j14_knn_land", _sql(roles.TARGETS, roles.GRID, _XY.format(land="is_land"), body=f"SELECT target_id, cell_id, r::INT AS rank FROM (SELECT target_id, cell_id, row_number() OVER (PARTITION BY target_id ORDER BY round({_D2}, 9), cell_id) AS r FROM t, c) WHERE r <= 16"))
def knn(spark, d):
    return _near(spark, d, 16, True).select("target_id", "cell_id", "rank")


@query("g02_patch_bbox", _sql(roles.GRID, body="SELECT min(x)::INT AS x0, max(x)::INT AS x1, min(y)::INT AS y0, max(y)::INT AS y1 FROM grid WHERE lat BETWEEN 35 AND 40 AND lon BETWEEN 15 AND 20"))
def bbox(spark, d):
    g = roles.grid(spark, d).where("lat BETWEEN 35 AND 40 AND lon BETWEEN 15 AND 20")
    return g.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


_PTS = "pts AS (SELECT id, lon AS px, lat AS py FROM targets)"


def _points(spark, d):
    return roles.targets(spark, d).select("id", F.col("lon").alias("px"), F.col("lat").alias("py"))


_T = "greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"


@query("j18_coast_distance", _sql(roles.SEGMENTS, roles.TARGETS, _PTS, f"d AS (SELECT id, px - (x1 + {_T} * (x2 - x1)) AS ex, py - (y1 + {_T} * (y2 - y1)) AS ey FROM pts, segments)", body="SELECT id, round(min(sqrt(ex * ex + ey * ey)), 6) AS coast_km FROM d GROUP BY 1"))
def coast(spark, d):
    return sp.coast_distance(_points(spark, d), roles.segments(spark, d)).withColumn("coast_km", r6(F.col("coast_km")))


def _fetch_sql() -> str:
    out = []
    for name, b in sp.BEARINGS.items():
        det = f"(sin(radians({b})) * (y2 - y1) - cos(radians({b})) * (x2 - x1))"
        t = f"((x1 - px) * (y2 - y1) - (y1 - py) * (x2 - x1)) / nullif({det}, 0)"
        s = f"((x1 - px) * cos(radians({b})) - (y1 - py) * sin(radians({b}))) / nullif({det}, 0)"
        out.append(f"round(ln(1 + coalesce(min(CASE WHEN {t} >= 0 AND {s} >= 0 AND {s} <= 1 AND {t} > 0.5 AND {t} <= 400 THEN {t} END), 400)), 6) AS fetch_{name}")
    return ", ".join(out)


@query("j19_fetch", _sql(roles.SEGMENTS, roles.TARGETS, _PTS, body=f"SELECT id, {_fetch_sql()} FROM pts, segments GROUP BY 1"))
def fetch(spark, d):
    return sp.fetch(_points(spark, d), roles.segments(spark, d), own_coast=0.5)


_GRAD = "SELECT cell_id, {v} FROM (SELECT *, lag(v) OVER (PARTITION BY y ORDER BY x) AS a, lead(v) OVER (PARTITION BY y ORDER BY x) AS b, lag(v) OVER (PARTITION BY x ORDER BY y) AS c, lead(v) OVER (PARTITION BY x ORDER BY y) AS e FROM grid)"
_G = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 WHEN {a} IS NULL THEN {b} - v WHEN {b} IS NULL THEN v - {a} ELSE ({b} - {a}) / 2 END"


@query("g05_terrain_aspect", _sql(roles.GRID, body=_GRAD.format(v=f"round({_G.format(a='a', b='b')}, 6) AS gx, round({_G.format(a='c', b='e')}, 6) AS gy")))
def aspect(spark, d):
    return sp.gradients(roles.grid(spark, d)).select("cell_id", r6(F.col("gx")).alias("gx"), r6(F.col("gy")).alias("gy"))


_NB = "(SELECT v FROM grid q WHERE q.x = g.x + {i} AND q.y = g.y + {j})"


@query("g10_slope", _sql(roles.GRID, "n AS (SELECT g.x, g.y, sum(CASE WHEN q.x > g.x THEN q.v WHEN q.x < g.x THEN -q.v ELSE 0 END) / 3 / 500 AS dx, sum(CASE WHEN q.y > g.y THEN q.v WHEN q.y < g.y THEN -q.v ELSE 0 END) / 3 / 500 AS dy, count(*) AS n FROM grid g JOIN grid q ON abs(q.x - g.x) <= 1 AND abs(q.y - g.y) <= 1 GROUP BY 1, 2)", body="SELECT x, y, round(CASE WHEN n = 9 THEN degrees(atan(sqrt(dx * dx + dy * dy))) ELSE 0 END, 5) AS slope_deg FROM n"))
def slope(spark, d):
    g = roles.grid(spark, d).select("x", "y", "v")
    out = sp.slopes(g)
    return out.select("x", "y", F.round("slope_deg", 5).alias("slope_deg"))


@query("a08_patch_mean", _sql(roles.GRID, body="SELECT g.cell_id, round(avg(q.v), 6) AS mean FROM grid g JOIN grid q ON q.x BETWEEN g.x - 2 AND g.x + 1 AND q.y BETWEEN g.y - 2 AND g.y + 1 GROUP BY 1"))
def patch_mean(spark, d):
    g = roles.grid(spark, d)
    near = g.select("cell_id", F.explode(F.sequence(F.col("x") - 2, F.col("x") + 1)).alias("x"), "y").select("cell_id", "x", F.explode(F.sequence(F.col("y") - 2, F.col("y") + 1)).alias("y"))
    return near.join(g.select("x", "y", "v"), ["x", "y"]).groupBy("cell_id").agg(r6(F.avg("v")).alias("mean"))


@query("w06_cell_edges", _sql(roles.GRID, "c AS (SELECT DISTINCT lon FROM grid)", body="SELECT round(lon, 6) AS lon, round(lon - coalesce(lon - lag(lon) OVER w, lead(lon) OVER w - lon, 1) / 2, 6) AS lo, round(lon + coalesce(lead(lon) OVER w - lon, lon - lag(lon) OVER w, 1) / 2, 6) AS hi FROM c WINDOW w AS (ORDER BY lon)"))
def edges(spark, d):
    # Distinct coordinates of one axis: a few thousand at most on any raster.
    c = roles.grid(spark, d).select("lon").distinct()
    w = Window.orderBy("lon")
    before, after, x = F.col("lon") - F.lag("lon").over(w), F.lead("lon").over(w) - F.col("lon"), F.col("lon")
    one = F.lit(1.0)
    return c.select(r6(x).alias("lon"), r6(x - F.coalesce(before, after, one) / 2).alias("lo"), r6(x + F.coalesce(after, before, one) / 2).alias("hi"))


@query("w07_grid_index", _sql(roles.GRID, body="SELECT cell_id, (dense_rank() OVER (ORDER BY round(lon, 9)) - 1)::INT AS i, (dense_rank() OVER (ORDER BY round(lat, 9)) - 1)::INT AS j FROM grid"))
def grid_index(spark, d):
    # Ranks come from each axis' distinct coordinates, not from a window over all cells.
    g = roles.grid(spark, d).select("cell_id", F.round("lon", 9).alias("a"), F.round("lat", 9).alias("b"))
    axis = lambda c, n: g.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).alias(n))
    return g.join(axis("a", "i"), "a").join(axis("b", "j"), "b").select("cell_id", "i", "j")


@query("g15_tile_math", _sql(roles.TARGETS, body="SELECT id, floor((lon + 180) / 360 * 4096)::BIGINT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS ty, round(floor((lon + 180) / 360 * 4096) / 4096 * 360 - 180, 6) AS west, round((id % 256) * 256 + (id % 200) + (id % 100) / 256 - 32768, 6) AS height FROM targets"))
def tiles(spark, d):
    tx, ty = sp.tile_of(F.col("lon"), F.col("lat"), 12)
    t = roles.targets(spark, d).select("id", tx.alias("tx"), ty.alias("ty"))
    west, _ = sp.tile_corner(F.col("tx"), F.col("ty"), 12)
    i = F.col("id")
    return t.select("id", "tx", "ty", r6(west).alias("west"), r6(sp.terrarium(i % 256, i % 200, i % 100)).alias("height"))


@query("g07_island_area", _sql(roles.TARGETS, _PTS, "b AS (SELECT s_suppkey AS polygon, 11 + (s_suppkey * 53 % 210) / 10.0e0 AS x, 33 + (s_suppkey * 37 % 100) / 10.0e0 AS y, 0.2 + s_nationkey / 20.0e0 AS h FROM supplier)", body="SELECT id, min(polygon)::BIGINT AS polygon, round(arg_min(4 * h * h, polygon), 6) AS area FROM pts JOIN b ON px >= x - h AND px < x + h AND py >= y - h AND py < y + h GROUP BY 1"))
def island(spark, d):
    s = roles.table(spark, d, "supplier").selectExpr("s_suppkey AS polygon", "11 + (s_suppkey * 53 % 210) / 10.0e0 AS x", "33 + (s_suppkey * 37 % 100) / 10.0e0 AS y", "0.2e0 + s_nationkey / 20.0e0 AS h")
    corner = [("x - h", "y - h"), ("x + h", "y - h"), ("x + h", "y + h"), ("x - h", "y + h")]
    sides = F.array(*[F.struct(*[F.expr(e).alias(n) for e, n in zip((*a, *b), ("x1", "y1", "x2", "y2"))]) for a, b in zip(corner, corner[1:] + corner[:1])])
    edges_ = s.select("polygon", F.explode(sides).alias("e")).select("polygon", "e.*")
    found = polygons.contains(_points(spark, d), edges_)
    return found.join(polygons.areas(edges_), "polygon").select("id", "polygon", r6(F.col("area")).alias("area"))

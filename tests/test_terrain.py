"""Rasters in tiles, land masses by cells and the projection, against cell-by-cell and edge-by-edge calculation."""

import math
import random

import numpy as np
import pytest

from meltemi.functions import projection
from meltemi.operators import polygons, raster
from meltemi.plans import roles, terrain

SF = "/root/testdata/sf0.001"


def rough(h, w, seed=0, gaps=0.03):
    rnd = np.random.default_rng(seed)
    a = np.cumsum(np.cumsum(rnd.normal(0, 8, (h, w)), 0), 1) / 5 + rnd.normal(0, 30, (h, w))
    a[rnd.random((h, w)) < gaps] = np.nan
    return a


def rows(a):
    return [(x, y, None if rand_null(x, y) and np.isnan(a[y, x]) else float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]


def rand_null(x, y):
    return (x + y) % 2 == 0


def brute(a, i, j, px, py, radii, far):
    h, w = a.shape
    if not (0 <= i < h and 0 <= j < w) or np.isnan(a[i, j]):
        return [0.0, 0.0, 0.0, *[0.0 for _ in radii], 1.0]
    out = [0.0, 0.0, 0.0]
    if 0 < i < h - 1 and 0 < j < w - 1 and not np.isnan(a[i - 1 : i + 2, j - 1 : j + 2]).any():
        p = a[i - 1 : i + 2, j - 1 : j + 2]
        north, east = (p[0].mean() - p[2].mean()) / (2 * py), (p[:, 2].mean() - p[:, 0].mean()) / (2 * px)
        out = [north / math.hypot(north, east), east / math.hypot(north, east), math.degrees(math.atan(math.hypot(north, east)))]
    for r in radii:
        near = [a[y, x] for y in range(h) for x in range(w) if (y, x) != (i, j) and math.hypot((y - i) * py, (x - j) * px) <= r and not np.isnan(a[y, x])]
        out.append(a[i, j] - np.mean(near) if len(near) >= 4 else 0.0)
    total = 0.0
    for q in range(16):
        top = 0.0
        for k in range(1, far + 1):
            y, x = i + round(-math.cos(2 * math.pi * q / 16) * k), j + round(math.sin(2 * math.pi * q / 16) * k)
            if 0 <= y < h and 0 <= x < w and not np.isnan(a[y, x]):
                top = max(top, (a[y, x] - a[i, j]) / math.hypot((y - i) * py, (x - j) * px))
        total += math.sin(math.atan(top)) ** 2
    return [*out, max(0.0, 1 - total / 16)]


@pytest.mark.parametrize("tile", [7, 16, None])
def test_tiles_give_what_the_whole_raster_gives(spark, tile):
    a = rough(40, 55)
    g = spark.createDataFrame(rows(a), "x int, y int, v double").repartition(6)
    rnd = random.Random(2)
    asked = [(k, rnd.randint(-2, 56), rnd.randint(-2, 41)) for k in range(200)] + [(900, 5, 5)] * 3 + [(901, None, 5)]
    p = spark.createDataFrame(asked, "id int, x int, y int")
    got = raster.terrain(p, g, px=20.0, py=25.0, radii=(60.0, 130.0), far=12, tile=tile).collect()
    assert len(got) == len(asked)
    for r in got:
        want = [0.0] * 5 + [1.0] if r.x is None else brute(a, r.y, r.x, 20.0, 25.0, (60.0, 130.0), 12)
        assert np.allclose([r.dem_northness, r.dem_eastness, r.dem_slope_deg, r.tpi_60, r.tpi_130, r.svf], want, atol=1e-9), r


def test_one_cell_asked_for_by_most_points_and_no_raster(spark):
    g = spark.createDataFrame(rows(rough(12, 12, gaps=0)), "x int, y int, v double")
    p = spark.range(3000).selectExpr("id", "if(id % 3 < 2, 6, cast(id % 12 as int)) as x", "6 as y")
    out = raster.terrain(p, g, radii=(500.0,), far=5)
    assert out.count() == 3000 and out.where("x = 6").select("tpi_500", "svf").distinct().count() == 1
    none = raster.terrain(p.limit(3), g.limit(0), radii=(500.0,), far=5).select(*[c for c in out.columns if c not in ("id", "x", "y")]).distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0.0, 0.0, 0.0, 1.0)]
    assert raster.terrain(p.limit(0), g, radii=(500.0,), far=5).count() == 0


def test_points_take_the_nearest_pixel(spark):
    a, t = rough(9, 8, 4, 0.0), (0.5, 0.0, 20.0, 0.0, -0.25, 40.0)
    g = spark.createDataFrame(rows(a), "x int, y int, v double")
    points = [(1, 20.0 + 0.5 * 3.4, 40.0 - 0.25 * 2.6), (2, 20.0 + 0.5 * 2.5, 40.0 - 0.25 * 3.5), (3, 10.0, 40.0), (4, None, 39.0), (5, 20.0 + 0.5 * 7.4, 40.0)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {r.id: r for r in raster.sampled(p, g, t, 20.0, 25.0, radii=(60.0,), far=4).collect()}
    assert len(got) == 5
    for k, (i, j) in {1: (3, 3), 2: (4, 2), 3: (-1, -1), 4: (-1, -1), 5: (0, 7)}.items():
        want = brute(a, i, j, 20.0, 25.0, (60.0,), 4)
        assert np.allclose([got[k].dem_northness, got[k].dem_eastness, got[k].dem_slope_deg, got[k].tpi_60, got[k].svf], want, atol=1e-9)
    px, py = raster.pixel_metres(t, 9)
    assert abs(py - 27830) < 1 and abs(px - 0.5 * 111320 * math.cos(math.radians(40 - 0.25 * 4.5))) < 1e-6


def star(n, cx, cy, r, rnd):
    a = [(cx + r * (0.4 + 0.6 * rnd.random()) * math.cos(2 * math.pi * k / n), cy + r * (0.4 + 0.6 * rnd.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return list(zip(a, a[1:] + a[:1]))


def ring(points):
    return list(zip(points, points[1:] + points[:1]))


def shapes():
    rnd = random.Random(6)
    out = {k: star(rnd.randint(3, 60), rnd.uniform(0, 20), rnd.uniform(0, 10), rnd.uniform(0.2, 6), rnd) for k in range(25)}
    out[30] = ring([(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)]) + ring([(5.0, 5.0), (9.0, 5.0), (9.0, 8.0), (5.0, 8.0)])  # a hole
    out[31] = ring([(1.0, 1.0), (3.0, 1.0), (2.0, 3.0)])
    return out


def inside(px, py, edges):
    return sum((a[1] > py) != (b[1] > py) and px < a[0] + (py - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in edges) % 2 == 1


@pytest.mark.parametrize("cell", [None, 0.3, 3.0, 50.0])
def test_points_in_polygons_edge_by_edge(spark, cell):
    polygons_ = shapes()
    e = spark.createDataFrame([(k, *a, *b) for k, edges in polygons_.items() for a, b in edges], "polygon int, x1 double, y1 double, x2 double, y2 double").repartition(5)
    rnd = random.Random(9)
    points = [(i, rnd.uniform(-2, 22), rnd.uniform(-2, 12)) for i in range(1500)] + [(2000 + i, 6.0, 6.0) for i in range(20)] + [(3000, None, 1.0)]
    points += [(4000 + i, float(i % 21), float(i % 11) + 0.5) for i in range(60)]
    p = spark.createDataFrame(points, "id int, px double, py double")
    got = {r.id: r.polygon for r in polygons.contains(p, e, cell).collect()}
    want = {}
    for i, x, y in points:
        found = [k for k, edges in polygons_.items() if x is not None and inside(x, y, edges)]
        if found:
            want[i] = min(found)
    assert got == want


def test_islands_by_area(spark):
    square = lambda k, x, half: [(k, *a, *b) for a, b in ring([(x - half, -half), (x + half, -half), (x + half, half), (x - half, half)])]
    e = spark.createDataFrame(square(1, 0.0, 10_000.0) + square(2, 500_000.0, 80_000.0), "polygon int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.0, 5.0), (2, 500_000.0, 5.0), (3, -90_000.0, 0.0)], "id int, px double, py double")
    assert sorted(map(tuple, polygons.island(p, e).collect()), key=str) == [(1, 1, True), (2, 2, False), (3, None, False)]
    assert polygons.island(p, e.limit(0)).where("not is_island").count() == 3


def test_clip_is_the_parity_of_every_pixel(spark):
    a, t = rough(30, 40, 8, 0.02) * 3, (0.5, 0.0, 0.0, 0.0, -0.35, 10.5)
    polygons_ = {k: v for k, v in shapes().items() if k % 5 == 0}
    e = spark.createDataFrame([(k, *p, *q) for k, edges in polygons_.items() for p, q in edges], "polygon int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.x, r.y): r.v for r in raster.clipped(spark.createDataFrame(rows(a), "x int, y int, v double"), e, t).collect()}
    want = {(x, y) for y in range(30) for x in range(40) if any(inside((x + 0.5) * 0.5, 10.5 - (y + 0.5) * 0.35, edges) for edges in polygons_.values())}
    assert set(got) == want and len(want) > 50
    assert all((v is None or math.isnan(v)) if math.isnan(a[y, x]) else v == max(0.0, a[y, x]) for (x, y), v in got.items())


def test_projection_of_a_published_point(spark):
    """50 N, 5 E of the projection's published example; its origin; nulls."""
    p = spark.createDataFrame([(5.0, 50.0), (10.0, 52.0), (None, 50.0)], "lon double, lat double")
    east, north = projection.laea(*map(p.__getitem__, ("lon", "lat")))
    a, b, c = p.select(east, north).collect()
    assert abs(a[0] - 3962799.45) < 0.01 and abs(a[1] - 2999718.85) < 0.01
    assert abs(b[0] - 4321000.0) < 1e-6 and abs(b[1] - 3210000.0) < 1e-6 and tuple(c) == (None, None)


def test_registered_queries_answer_everything(spark):
    targets, cells = roles.targets(spark, SF).count(), roles.grid(spark, SF).count()
    run = lambda n: terrain.QUERIES[n][0](spark, SF)
    w = run("g04_cubic_weights").toPandas()
    assert len(w) == targets and np.allclose(w.total, 1)
    assert run("g13_dem_features").count() == run("g07_is_island").count() == run("g03_nearest_land").count() == targets
    assert run("g11_tpi").count() == run("g12_svf").count() == cells

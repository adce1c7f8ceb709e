"""Coast distance and fetch against all segments of the whole raster."""

import numpy as np

from meltemi.operators import spatial
from meltemi.plans import places, roles

SF = "/root/testdata/sf0.001"


def brute(p, s, own):
    x1, y1, x2, y2 = s.T
    sx, sy = x2 - x1, y2 - y1
    t = np.clip(((p[0] - x1) * sx + (p[1] - y1) * sy) / np.maximum(sx * sx + sy * sy, 1e-300), 0, 1)
    out = [np.hypot(p[0] - x1 - t * sx, p[1] - y1 - t * sy).min()]
    for b in spatial.BEARINGS.values():
        ux, uy = np.sin(np.radians(b)), np.cos(np.radians(b))
        with np.errstate(all="ignore"):
            det = ux * sy - uy * sx
            t, at = ((x1 - p[0]) * sy - (y1 - p[1]) * sx) / det, ((x1 - p[0]) * uy - (y1 - p[1]) * ux) / det
            out.append(np.log1p(min(t[(at >= 0) & (at <= 1) & (t > own) & (t <= 400)], default=400)))
    return out


def compared(coast, fetch, points, s, own):
    got = {r.id: [r.coast_km] for r in coast.collect()}
    for r in fetch.collect():
        got[r.id] += [r[f"fetch_{n}"] for n in spatial.BEARINGS]
    assert got.keys() == points.keys()
    for i, p in points.items():
        assert np.allclose(got[i], brute(p, s, own), atol=2e-6), i


def test_random_coast(spark):
    rnd = np.random.default_rng(6)
    s = rnd.uniform(-20, 20, (300, 2))
    s = np.hstack([s, s + rnd.normal(0, 1, (300, 2))])
    s[0] = [-20, -20, 25, 30]
    points = dict(enumerate(map(tuple, rnd.uniform(-60, 60, (60, 2)).tolist())))
    p = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, px double, py double")
    seg = spark.createDataFrame(s.tolist(), "x1 double, y1 double, x2 double, y2 double")
    compared(spatial.coast_distance(p, seg), spatial.fetch(p, seg, own_coast=0.5), points, s, 0.5)


def test_every_segment_counts(spark, tmp_path):
    # 400 cells reach beyond row 4; points stand beside the last of them.
    spark.range(400).selectExpr("id as p_partkey", "100.0d + id as p_retailprice", "30 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 100.0, 1) for k in range(40)], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    k = np.arange(400)
    lon, lat = 11 + k % 50 * 0.42, 33 + k // 50 * 0.25
    s = np.column_stack([lon[:-1], lat[:-1] + (100 + k[:-1]) / 1000, lon[1:], lat[1:]])
    assert roles.segments(spark, str(tmp_path)).count() == 399
    points = {i: (11 + i * 53 % 210 / 10, 33 + i * 37 % 100 / 10) for i in range(40)}
    compared(places.coast(spark, str(tmp_path)), places.fetch(spark, str(tmp_path)), points, s, 0.5)


def test_a_place_is_looked_up_once(spark, monkeypatch):
    """Points of one place all have their answer, and no more pairs are met for them than for one."""
    rnd = np.random.default_rng(8)
    s = rnd.uniform(-20, 20, (200, 2))
    s = np.hstack([s, s + rnd.normal(0, 1, (200, 2))])
    at = rnd.uniform(-25, 25, (5, 2)).tolist()
    points = {i: tuple(at[i % 5]) for i in range(200)}
    p = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, px double, py double")
    seg = spark.createDataFrame(s.tolist(), "x1 double, y1 double, x2 double, y2 double")
    looked = []
    for name in ("_coast_distance", "_fetch", "_nearest_cells"):
        run = getattr(spatial, name)
        monkeypatch.setattr(spatial, name, lambda t, *a, run=run: looked.append(t.count()) or run(t, *a))
    compared(spatial.coast_distance(p, seg), spatial.fetch(p, seg, own_coast=0.5), points, s, 0.5)
    cells = spark.createDataFrame([(j, *v) for j, v in enumerate(s[:, :2].tolist())], "cell_id long, x double, y double")
    near = spatial.nearest_cells(p.selectExpr("id as target_id", "px as x", "py as y"), cells, 3)
    got = {(r.target_id, r.rank): r.cell_id for r in near.collect()}
    assert got == {(i, r + 1): int(j) for i, v in points.items() for r, j in enumerate(np.argsort(((s[:, :2] - v) ** 2).sum(1))[:3])}
    assert looked == [5, 5, 5]

"""Spatial queries answer every target and cell; brute force on the smallest tables."""

import math

import pytest

from meltemi.plans import places, roles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return roles.targets(spark, SF).toPandas(), roles.grid(spark, SF).toPandas()


def run(spark, name):
    return places.QUERIES[name][0](spark, SF).toPandas()


def order(t, cells):
    """cell_id of the cells from the nearest on, ties to the lower one."""
    c = math.cos(math.radians(38.0))
    d2 = ((t.lon - cells.lon) * c) ** 2 + (t.lat - cells.lat) ** 2
    return cells.assign(d2=d2.round(9)).sort_values(["d2", "cell_id"])


@pytest.mark.parametrize("name, land, k", [("j13_nearest_cell", False, 1), ("j14_knn_land", True, 16)])
def test_every_target_has_its_cells(spark, tables, name, land, k):
    targets, grid = tables
    cells = grid[grid.is_land] if land else grid
    got = run(spark, name).groupby("target_id").cell_id.apply(set).to_dict()
    assert got == {t.id: set(order(t, cells).cell_id[:k]) for t in targets.itertuples()}


def test_every_cell_has_its_patch_mean(spark, tables):
    _, g = tables
    got = run(spark, "a08_patch_mean").set_index("cell_id")["mean"].to_dict()
    assert got.keys() == set(g.cell_id)
    for c in g.itertuples():
        assert abs(got[c.cell_id] - g[g.x.between(c.x - 2, c.x + 1) & g.y.between(c.y - 2, c.y + 1)].v.mean()) < 1e-5


def test_every_point_has_its_polygon(spark, tables):
    targets, _ = tables
    s = roles.table(spark, SF, "supplier").toPandas()
    x, y, h = 11 + s.s_suppkey * 53 % 210 / 10, 33 + s.s_suppkey * 37 % 100 / 10, 0.2 + s.s_nationkey / 20
    want = {}
    for t in targets.itertuples():
        inside = s.s_suppkey[(t.lon >= x - h) & (t.lon < x + h) & (t.lat >= y - h) & (t.lat < y + h)]
        if len(inside):
            want[t.id] = inside.min()
    got = run(spark, "g07_island_area").set_index("id").polygon.to_dict()
    assert got == want and any(i % 10 for i in want)


def test_every_target_is_answered(spark, tables):
    targets, _ = tables
    for name in ("j18_coast_distance", "j19_fetch"):
        assert set(run(spark, name).id) == set(targets.id)

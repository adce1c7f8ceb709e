"""The cubic surface over patches, against one that solves for its control values instead of writing them down."""

import itertools
import math

import numpy as np
import pytest

from meltemi.operators import interpolate

MULTI = [(i, j, 3 - i - j) for i in range(4) for j in range(4 - i)]


def bezier(b):
    """Bernstein weights of a cubic triangle at barycentric b."""
    return np.array([math.factorial(3) / math.prod(map(math.factorial, m)) * math.prod(x**e for x, e in zip(b, m)) for m in MULTI])


def slope(b, d):
    """Weights of the derivative at b along a barycentric direction d."""
    out = np.zeros(len(MULTI))
    for k, m in enumerate(MULTI):
        for a in range(3):
            if m[a]:
                low = [e - (x == a) for x, e in enumerate(m)]
                out[k] += 3 * d[a] * math.factorial(2) / math.prod(map(math.factorial, low)) * math.prod(x**e for x, e in zip(b, low))
    return out


def brute(xy, triangles, values, at):
    """Gradients by minimising the curvature of all edges, control values by least squares on the conditions."""
    n = len(xy)
    rows, rhs = [], []
    for i, j in {tuple(sorted(e)) for t in triangles.tolist() for e in itertools.combinations(t, 2)}:
        e, d = xy[j] - xy[i], values[j] - values[i]
        length = np.hypot(*e)
        # The second derivative of a cubic is linear; two Gauss points give its squared integral.
        for s in (0.5 - math.sqrt(3) / 6, 0.5 + math.sqrt(3) / 6):
            row = np.zeros(2 * n)
            row[2 * i : 2 * i + 2], row[2 * j : 2 * j + 2] = (6 * s - 4) * e, (6 * s - 2) * e
            w = math.sqrt(0.5 / length**3)
            rows.append(w * row)
            rhs.append(-w * (6 - 12 * s) * d)
    g = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0].reshape(n, 2)
    for k, t in enumerate(triangles.tolist()):
        v = np.vstack([xy[t], xy[t].mean(0)])
        b = np.linalg.solve(np.vstack([v[:3].T, np.ones(3)]), [*at, 1.0])
        if b.min() < -1e-9:
            continue
        # Unknowns: ten control values of each of the three cubics.
        subs = [(0, 1, 3), (1, 2, 3), (2, 0, 3)]
        eq, want = [], []

        def say(parts, value):
            row = np.zeros(30)
            for s, w in parts:
                row[10 * s : 10 * s + 10] += w
            eq.append(row)
            want.append(value)

        inside = lambda s, p: np.linalg.solve(np.vstack([v[list(subs[s])].T, np.ones(3)]), [*p, 1.0])
        for s, (p, q, c) in enumerate(subs):
            for end in (p, q):
                say([(s, bezier(inside(s, v[end])))], values[t[end]])
                for axis in np.eye(2):
                    d = inside(s, v[end] + axis) - inside(s, v[end])
                    say([(s, slope(inside(s, v[end]), d))], axis @ g[t[end]])
            beyond = [m for m in range(len(triangles)) if m != k and {t[p], t[q]} <= set(triangles[m].tolist())]
            if beyond:
                across = v[3] - xy[triangles[beyond[0]]].mean(0)
            else:
                across = v[3] - (v[p] + v[q]) / 2
            d = inside(s, v[p] + across) - inside(s, v[p])
            first, half, last = (slope(inside(s, v[p] + f * (v[q] - v[p])), d) for f in (0, 0.5, 1))
            say([(s, first + last - 2 * half)], 0.0)
            # Value and slopes agree with the next cubic along their common edge.
            r = (s + 1) % 3
            for f in np.linspace(0, 1, 5):
                place = v[q] + f * (v[3] - v[q])
                say([(s, bezier(inside(s, place))), (r, -bezier(inside(r, place)))], 0.0)
                for axis in np.eye(2):
                    ds, dr = (inside(x, place + axis) - inside(x, place) for x in (s, r))
                    say([(s, slope(inside(s, place), ds)), (r, -slope(inside(r, place), dr))], 0.0)
        c, left, *_ = np.linalg.lstsq(np.array(eq), np.array(want), rcond=None)
        assert np.abs(np.array(eq) @ c - want).max() < 1e-8
        s = max(range(3), key=lambda s: inside(s, at).min())
        return bezier(inside(s, at)) @ c[10 * s : 10 * s + 10]
    return None


@pytest.mark.parametrize("seed", range(6))
def test_surface_of_scattered_points(seed):
    rnd = np.random.default_rng(seed)
    xy, values = rnd.uniform(-1, 1, (rnd.integers(4, 14), 2)), None
    values = np.sin(3 * xy[:, 0]) * xy[:, 1] + rnd.normal(size=len(xy))
    s = interpolate.Surface(xy)
    for at in rnd.uniform(-1, 1, (12, 2)):
        w, want = s.weights(at), brute(xy, s.triangles, values, at)
        assert (w is None) == (want is None)
        if w is not None:
            assert abs(w @ values - want) < 1e-6


def test_triangles_hold_no_other_point_in_their_circle():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        xy = rnd.uniform(0, 1, (rnd.integers(3, 17), 2))
        t = interpolate.triangulated(xy)
        corners = xy[t]
        u, v = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
        area = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2
        assert len(t)
        for a, b, c in corners:
            centre = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
            assert (np.hypot(*(xy - centre).T) >= np.hypot(*(a - centre)) - 1e-6).all()
        assert area <= 1.0


def test_regular_grid_is_covered_once_and_planes_are_kept():
    xy = np.array([[i * 0.25, j * 0.42] for i in range(4) for j in range(4)])
    s = interpolate.Surface(xy)
    u, v = (xy[s.triangles[:, k]] - xy[s.triangles[:, 0]] for k in (1, 2))
    assert len(s.triangles) == 18 and abs(np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2 - 0.75 * 1.26) < 1e-9
    plane = 2 + 3 * xy[:, 0] - xy[:, 1]
    for at in np.random.default_rng(1).uniform(0, 1, (50, 2)) * [0.75, 1.26]:
        assert abs(s.weights(at) @ plane - (2 + 3 * at[0] - at[1])) < 1e-9
    for i, p in enumerate(xy):
        assert np.allclose(s.weights(p), np.eye(16)[i], atol=1e-9)


def test_slopes_do_not_jump_between_triangles():
    rnd = np.random.default_rng(5)
    xy = rnd.uniform(0, 1, (12, 2))
    values = rnd.normal(size=12)
    s = interpolate.Surface(xy)
    f = lambda p: s.weights(p) @ values
    inner = [e for e, k in s.edges.items() if len(k) == 2]
    assert len(inner) > 5
    for i, j in inner:
        middle, e = 0.4 * xy[i] + 0.6 * xy[j], xy[j] - xy[i]
        jumps = []
        for h in (1e-5, 1e-6):
            across = np.array([-e[1], e[0]]) / np.hypot(*e) * h
            jumps.append(abs((f(middle + across) - 2 * f(middle) + f(middle - across)) / h))
        # Of a slope without a jump what is left falls with the step.
        assert jumps[1] < 0.2 * jumps[0] + 1e-7


def grid(spark, land):
    rows = [(10 * y + x, x, y, 20 + 0.4 * x + 0.02 * y, 37 + 0.25 * y, bool(land(x, y))) for y in range(9) for x in range(10)]
    return spark.createDataFrame(rows, "cell_id long, x int, y int, lon double, lat double, is_land boolean"), rows


def test_patches_and_weights_at_every_target(spark):
    """Blocks around land, cut off at the border; nearest land at sea; the nearest cell outside the hull."""
    g, cells = grid(spark, lambda x, y: x < 6)
    targets = [(1, 20.9, 38.1), (2, 20.01, 37.01), (3, 22.0, 39.0), (4, 22.9, 37.6), (5, 24.9, 41.0), (6, 22.3, 38.2), (7, 19.0, 36.0)]
    t = spark.createDataFrame(targets, "target_id long, lon double, lat double")
    p = interpolate.patches(t, g)
    scale = math.cos(math.radians(np.mean([c[4] for c in cells])))
    want = set()
    for i, lon, lat in targets:
        far = lambda c: (round(((c[3] - lon) * scale) ** 2 + (c[4] - lat) ** 2, 9), c[0])
        near = min(cells, key=far)
        if near[5]:
            x0, y0 = max(0, near[1] - 2), max(0, near[2] - 2)
            want |= {(i, c[0]) for c in cells if x0 <= c[1] < x0 + 4 and y0 <= c[2] < y0 + 4}
        else:
            want |= {(i, c[0]) for c in sorted((c for c in cells if c[5]), key=far)[:16]}
    assert {tuple(r) for r in p.collect()} == want
    got = {}
    for r in interpolate.cubic_weights(p, t, g).collect():
        got.setdefault(r.target_id, {})[r.cell_id] = r.weight
    where = {c[0]: c for c in cells}
    value = lambda c: math.sin(c[3] * 2) + (c[4] - 38) ** 2
    for i, lon, lat in targets:
        ids = sorted(got[i])
        xy = np.array([[where[c][4], where[c][3]] for c in ids])
        values = np.array([value(where[c]) for c in ids])
        want_value = brute(xy, interpolate.triangulated(xy), values, np.array([lat, lon]))
        if want_value is None:
            want_value = value(where[min(ids, key=lambda c: math.hypot(where[c][4] - lat, (where[c][3] - lon) * math.cos(math.radians(lat))))])
        assert abs(sum(w * value(where[c]) for c, w in got[i].items()) - want_value) < 1e-6


def test_too_few_land_cells_are_an_error_and_sea_is_kept_without_land(spark):
    g, _ = grid(spark, lambda x, y: (x, y) in {(0, 0), (1, 0), (0, 1)})
    t = spark.createDataFrame([(1, 22.0, 39.0)], "target_id long, lon double, lat double")
    with pytest.raises(Exception, match="too few land cells near target 1"):
        interpolate.patches(t, g).collect()
    own = interpolate.nearest_land(t, g, candidates=4).first().cell_id
    assert own not in (0, 1, 10)
    assert interpolate.nearest_land(t, g, candidates=90).first().cell_id in (0, 1, 10)


def test_series_with_gaps(spark):
    w = spark.createDataFrame([(1, 5, 0.25), (1, 6, 0.75), (1, 7, 0.0)], "target_id long, cell_id long, weight double")
    s = spark.createDataFrame([(5, 1, 8.0), (6, 1, 4.0), (7, 1, None), (5, 2, 1.0), (6, 2, None), (7, 2, 3.0)], "cell_id long, day int, v double")
    assert sorted(map(tuple, interpolate.interpolated(w, s, ["day"], ["v"]).collect())) == [(1, 1, 5.0), (1, 2, None)]

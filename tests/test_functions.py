import math

import numpy as np
from pyspark.sql import functions as F

from meltemi.functions import calendar as cal
from meltemi.functions import gamma
from meltemi.functions import numeric as nm
from meltemi.functions import weather as wx
from meltemi.operators import quantile_map as qm


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_null_propagation(spark):
    a, b = F.col("a"), F.col("b")
    rows = [(1.0, None), (None, None), (5.0, 3.0)]
    assert values(spark, nm.pmin(a, b), rows, "a double, b double") == [None, None, 3.0]
    assert values(spark, nm.pmax(a, b), rows, "a double, b double") == [None, None, 5.0]
    assert values(spark, nm.clip(a, 2.0, 4.0), rows, "a double, b double") == [2.0, None, 4.0]
    assert values(spark, wx.gust_factor(a, b), [(4.0, 2.0), (4.0, 0.0), (None, 2.0), (90.0, 1.0), (1.0, 2.0)], "a double, b double") == [2.0, 1.0, 1.0, 10.0, 1.0]


def test_masks(spark):
    rows = [("12.3*",), ("9999.9",), ("10000",), ("x",), (None,), (" 7 ",)]
    assert values(spark, wx.masked(F.col("a"), 9999.9), rows, "a string") == [12.3, None, None, None, None, 7.0]


def test_quantiles_and_interpolation_match_numpy(spark):
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        a = np.sort(rnd.integers(0, 9, n).astype(float))
        got = values(spark, nm.quantiles(F.col("a"), 11), [(a.tolist(),)], "a array<double>")[0]
        assert np.allclose(got, np.quantile(a, np.linspace(0, 1, 11)))
    xs, ys = [0.0, 1.0, 1.0, 3.0], [5.0, 6.0, 8.0, 9.0]
    x = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0]
    c = nm.interpolated(F.col("x"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys)))
    assert values(spark, c, [(v,) for v in x], "x double") == [5.0, 5.0, 5.5, 8.0, 8.5, 9.0, 9.0]


def test_days(spark):
    got = values(spark, cal.nearest_centre(F.col("d"), cal.centres(), 366), [(i,) for i in (1, 16, 17, 366, 350)], "d int")
    assert got == [1, 1, 31, 1, 361]
    assert values(spark, cal.doy360(F.col("m"), F.col("d")), [(2, 30), (12, 30)], "m int, d int") == [60, 360]


def test_gamma_table():
    for k in (0.3, 1.0, 4.5, 60.0):
        assert abs(gamma._cdf(k, gamma.ppf(0.9, k)) - 0.9) < 1e-9
    assert math.isclose(gamma.ppf(0.5, 1.0), math.log(2), rel_tol=1e-9)


def fit_numpy(o, m, n, wet):
    om, mm = np.mean(o) if len(o) else 0.0, np.mean(m) if len(m) else 0.0
    o, m = np.array(o, float), np.array(m, float)
    share = (o > wet).mean() if len(o) else 0
    thr = np.quantile(m, 1 - share) if share > 0 and len(m) else 0.0
    o, m = o[o > wet], m[m > thr]
    if len(o) < 2 or len(m) < 2:
        both = np.concatenate([o, m])
        r = np.linspace(both.min(), both.max(), n) if len(both) else np.linspace(0, 1, n)
        return r, r, om, mm, thr
    p = np.linspace(0, 1, n)
    return np.quantile(m, p), np.quantile(o, p), om, mm, thr


def test_mapping_matches_numpy(spark):
    cases = [
        ([0, 0, 1.5, 4, 9.25], [0, 0.2, 0.3, 2, 7]),
        ([0, 0, 0], [0.1, 0.4, 2]),
        ([0, 3, 0], [0, 1, 5]),
        ([1, 2, 3, 4], [5, 5, 5, 9]),
        ([2.0], [1.0]),
    ]
    rows = [(i, float(o), float(m)) for i, (a, b) in enumerate(cases) for o, m in zip(a, b)]
    df = spark.createDataFrame(rows + [(0, None, None)], "k int, obs double, mdl double")
    t = qm.fit(df, ["k"], n=11, precip=True)
    x = spark.createDataFrame([(i, v) for i in range(len(cases)) for v in (None, 0.0, 0.25, 1.0, 2.5, 5.0, 6.5, 50.0)], "k int, x double").join(t, "k")
    for r in x.withColumn("y", qm.applied(F.col("x"), True)).collect():
        mq, oq, om, mm, thr = fit_numpy(*cases[r.k], 11, 0.1)
        if r.x is None:
            assert r.y is None
            continue
        y = np.interp(r.x, mq, oq) if mq[0] <= r.x <= mq[-1] else r.x + om - mm
        assert math.isclose(r.y, 0.0 if r.x <= thr else max(y, 0.0), abs_tol=1e-9), (r.k, r.x)

"""Every donor is a fold, and every point and scenario a series."""

import numpy as np

from meltemi.plans import mapping, projections, roles

SF = "/root/testdata/sf0.001"


def test_every_donor_is_left_out(spark):
    d = roles.donor(spark, SF, 0).toPandas().astype({"obs": float, "mdl": float})
    got = mapping.QUERIES["j21_loo_donors"][0](spark, SF).toPandas().set_index("fold")
    assert set(got.index) == set(d.id)
    for k in got.index:
        assert got.n[k] == (d.id != k).sum() and abs(got.obs_mean[k] - d.obs[d.id != k].mean()) < 2e-6


def test_leave_one_out_of_many_donors(spark):
    from meltemi.operators import quantile_map as qm

    rnd = np.random.default_rng(8)
    rows = [(i, 1, float(max(0, o)), float(max(0, m))) for i in range(20) for o, m in np.round(rnd.normal(3, 4, (40, 2)), 1)]
    df = spark.createDataFrame(rows, "id long, doy int, obs double, mdl double")
    got = qm.leave_one_out(df, "id", df.select("id").distinct(), n=50).toPandas()
    assert len(got) == len(rows)
    for k, own in got.groupby("id"):
        o, m = (np.array([r[c] for r in rows if r[0] != k]) for c in (2, 3))
        thr = np.quantile(m, 1 - (o > 0.1).mean())
        p = np.linspace(0, 1, 50)
        mq, oq = np.quantile(m[m > thr], p), np.quantile(o[o > 0.1], p)
        for x, y in zip(own.mdl, own.mapped):
            if x <= thr:
                want = 0.0
            elif x < mq[0] or x > mq[-1]:
                want = max(0.0, x + o.mean() - m.mean())
            else:
                at = np.searchsorted(mq, x, "right") - 1
                want = oq[-1] if at == len(mq) - 1 else oq[at] + (oq[at + 1] - oq[at]) * (x - mq[at]) / (mq[at + 1] - mq[at])
            assert abs(y - want) < 1e-6


def test_every_series_is_mapped(spark):
    e = roles.ens(spark, SF).select("model", "scenario", "point", "date").toPandas()
    got = projections.QUERIES["n11_projection_eqm"][0](spark, SF).toPandas()
    key = ["model", "scenario", "point", "date"]
    assert set(map(tuple, got[key].values)) == set(map(tuple, e[key].values)) and len(got) == len(e)
    grid = projections.QUERIES["n05_eqm_grid"][0](spark, SF).toPandas()
    assert set(zip(grid.scenario, grid.point)) == set(zip(e.scenario, e.point))


def test_no_table_of_folds_is_gathered(spark):
    """Lists of quantiles compress well, so estimates of their size mislead: all joins but those of one row are shuffled."""
    from meltemi.operators import quantile_map as qm

    df = spark.range(400).selectExpr("id % 20 as id", "cast(id % 366 + 1 as int) as doy", "cast(id % 7 as double) as obs", "cast(id % 11 as double) as mdl")
    out = qm.leave_one_out(df, "id", df.select("id").distinct(), n=20)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 400

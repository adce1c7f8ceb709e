"""Correction of an ensemble, stores of daily values, and headers that are too long."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltemi.operators import quantile_map as qm
from meltemi.sources import stations, stores


def brute(x, o, m, precip):
    om, mm, thr = o.mean(), m.mean(), 0.0
    if precip:
        share = (o > 0.1).mean()
        thr = np.quantile(m, 1 - share) if share > 0 else 0.0
        o, m = o[o > 0.1], m[m > thr]
    if len(o) < 2 or len(m) < 2:
        both = np.concatenate([o, m])
        oq = mq = np.linspace(both.min(), both.max(), 50) if len(both) else np.linspace(0, 1, 50)
    else:
        oq, mq = (np.quantile(v, np.linspace(0, 1, 50)) for v in (o, m))
    y = np.interp(x, mq, oq) if mq[0] <= x <= mq[-1] else x + om - mm
    return (0.0 if x <= thr else max(0.0, y)) if precip else y


def test_every_variable_calendar_and_limit(spark):
    rnd = np.random.default_rng(3)
    names = ["tmean", "tmin", "tmax", "rh", "wind", "precip"]
    value = lambda: [float(v) for v in (rnd.normal(15, 5), rnd.normal(14, 5), rnd.normal(16, 5), rnd.uniform(60, 110), rnd.normal(1, 2), max(0, rnd.normal(0, 4)))]
    truth = [(p, d, *value()) for p in (0, 1) for d in range(1, 366, 3)]
    series, day = [], dt.date(1990, 1, 1)
    for m, length in (("long", 365), ("short", 360)):
        for s in ("historical", "late"):
            for p in (0, 1):
                series += [(m, s, p, day + dt.timedelta(d), d, "360_day" if length == 360 else "standard", d % 2 == 1, *value(), 1.5) for d in range(1, length + 1, 7)]
    t = spark.createDataFrame(truth, "point int, doy int, " + ", ".join(f"{n} double" for n in names))
    e = spark.createDataFrame(series, "model string, scenario string, point int, date date, doy int, calendar string, calibrating boolean, " + ", ".join(f"{n} double" for n in names) + ", extra double").repartition(5)
    got = {(r.model, r.scenario, r.point, r.date): r for r in qm.ensemble(t, e, n=50).collect()}
    assert len(got) == len(series)
    circle = lambda a, b, n: min(abs(a - b), n - abs(a - b)) <= 15
    for r in series[::5]:
        m, s, p, date, d, calendar = r[:6]
        length = 360 if calendar == "360_day" else 365
        year_day = d if length == 365 else min(365, max(1, round((d - 0.5) / 360 * 365 + 0.5)))
        want = {}
        for k, v in enumerate(names):
            o = np.array([x[2 + k] for x in truth if x[0] == p and circle(x[1], year_day, 365)])
            c = np.array([x[7 + k] for x in series if x[0] == m and x[1] == "historical" and x[6] and x[2] == p and circle(x[4], d, length)])
            want[v] = brute(r[7 + k], o, c, v == "precip")
        want["rh"], want["wind"] = min(100.0, max(0.0, want["rh"])), max(0.0, want["wind"])
        want["tmin"], want["tmax"] = min(want["tmin"], want["tmean"]), max(want["tmax"], want["tmean"])
        row = got[m, s, p, date]
        assert row.extra == 1.5 and all(abs(row[v] - want[v]) < 1e-9 for v in names)


def test_what_cannot_be_corrected_stays(spark):
    e = spark.createDataFrame([("m", "late", 0, dt.date(2000, 1, 1), 1, "standard", False, 1.0)], "model string, scenario string, point int, date date, doy int, calendar string, calibrating boolean, snow double")
    t = spark.createDataFrame([(0, 1, 2.0)], "point int, doy int, tmean double")
    assert qm.ensemble(t, e).collect() == e.collect()
    # Without calibrating rows a day stays null.
    e = e.withColumn("tmean", F.lit(3.0))
    assert qm.ensemble(t, e).first().tmean is None
    assert qm.ensemble(t, e, variables=["rh"]).first().tmean == 3.0


def days(spark, first, n, **values):
    rows = [(p, dt.date.fromisoformat(first) + dt.timedelta(k), *[v + k + 100 * p for v in values.values()]) for p in (1, 2) for k in range(n)]
    return spark.createDataFrame(rows, "point int, date date, " + ", ".join(f"{v} double" for v in values))


def content(df):
    return {(r.point, str(r.date), r.variable): r.value for r in df.collect()}


def test_a_range_of_a_variable_is_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.replace(days(spark, "2000-12-20", 30, tmean=0.0, rh=50.0), path, ["tmean", "rh"], "2000-12-20", "2001-01-18")
    before = stores.read(spark, path)
    first = content(before)
    assert len(first) == 120 and first[1, "2000-12-21", "rh"] == 151.0
    stores.replace(days(spark, "2000-12-30", 4, tmean=900.0), path, ["tmean"], "2000-12-30", "2001-01-05")
    now = content(stores.read(spark, path))
    # The new days, no other ones of the range, and all that is outside it.
    fresh = {(p, str(dt.date(2000, 12, 30) + dt.timedelta(k)), "tmean"): 900.0 + k + 100 * p for p in (1, 2) for k in range(4)}
    kept = {k: v for k, v in first.items() if k[2] == "rh" or not "2000-12-30" <= k[1] <= "2001-01-05"}
    assert now == kept | fresh
    # Whoever read before still does.
    assert content(before) == first
    assert set(content(stores.read(spark, path, ["rh"]))) == {k for k in first if k[2] == "rh"}


def test_what_is_missing_raises_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        stores.read(spark, path)
    stores.replace(days(spark, "2000-01-01", 3, rh=1.0), path, ["rh"], "2000-01-01", "2000-01-03")
    before = content(stores.read(spark, path))
    with pytest.raises(KeyError, match="missing wind"):
        stores.replace(days(spark, "2000-01-01", 3, rh=2.0), path, ["rh", "wind"], "2000-01-01", "2000-01-03")
    with pytest.raises(ValueError, match="rows outside"):
        stores.replace(days(spark, "2000-01-01", 3, rh=2.0), path, ["rh"], "2000-01-01", "2000-01-02")
    with pytest.raises(KeyError, match="missing gust"):
        stores.read(spark, path, ["gust"])
    assert content(stores.read(spark, path)) == before
    stores.replace(days(spark, "2000-01-01", 3, rh=2.0).limit(0), path, ["rh"], "2000-01-01", "2000-01-02")
    assert set(content(stores.read(spark, path))) == {(1, "2000-01-03", "rh"), (2, "2000-01-03", "rh")}


def test_longer_headers_are_an_error(spark, tmp_path):
    (tmp_path / "2001").mkdir()
    names = ["STATION", "DATE", "LATITUDE", *[f"X{k}" for k in range(70)], "LONGITUDE"]
    (tmp_path / "2001" / "a.csv").write_text(",".join(names) + "\n" + ",".join(["7", "2001-05-05", "38"] + ["1"] * 70 + ["20"]) + "\n")
    with pytest.raises(Exception, match="more than 64 columns"):
        stations.read_stations(spark, str(tmp_path), 2001, 2001).collect()


def test_nothing_to_map_leaves_the_frame(spark):
    donors = spark.createDataFrame([(d, float(d % 7), float(d % 5)) for d in range(1, 366)], "doy int, obs double, mdl double")
    df = spark.createDataFrame([(1, 10, 2.0, 3.0)], "id int, doy int, baseline double, precip_best double")
    assert "precip_best_eqm" in qm.blended_onto(df, donors).columns
    want = 0.6 * qm.seasonal(df, donors, "baseline", "m").first().m + 0.4 * 3.0
    assert abs(qm.blended_onto(df, donors).first().precip_best_eqm - want) < 1e-12
    for got in (qm.blended_onto(df, None), qm.blended_onto(df, donors.limit(0)), qm.blended_onto(df, donors.withColumn("obs", F.lit(None).cast("double")))):
        assert got.columns == df.columns
    assert qm.blended_onto(df.drop("precip_best"), donors).columns == ["id", "doy", "baseline"]


def test_members_of_a_folder(spark, tmp_path):
    from meltemi.sources import files

    for n in ("b_bc_historical.nc", "a_x_bc_historical.nc", "a_x_bc_late.nc", "c_bc_late.nc", "other.nc"):
        (tmp_path / n).write_bytes(b"x")
    got = files.discovered(spark, str(tmp_path), {"b"}, ("historical", "late")).collect()
    assert [(r.member, r.scenario, r.short_year) for r in got] == [("a_x", "historical", False), ("a_x", "late", False), ("b", "historical", True)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c_bc_late.nc").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        files.discovered(spark, str(tmp_path / "none"))


def test_series_of_years_and_a_box(spark, tmp_path):
    from meltemi.sources import files

    rows = [("m", "s", y, 3, 30, c, lon, 38.0, 1.0) for y in (2000, 2001) for c in ("360_day", "standard") for lon in (20.0, 25.0)]
    df = spark.createDataFrame(rows, "model string, scenario string, year int, month int, day int, calendar string, lon double, lat double, v double")
    files.write_series(df, str(tmp_path / "s"))
    got = files.read_series(spark, str(tmp_path / "s"), (2001, 2001), (24.0, 26.0, 37.0, 39.0)).collect()
    assert sorted((r.year, r.lon, r.doy) for r in got) == [(2001, 25.0, 89), (2001, 25.0, 90)]

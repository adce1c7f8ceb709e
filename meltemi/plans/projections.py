"""Ensemble statistics of climate projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions.numeric import r6
from meltemi.operators import indices as ix
from meltemi.operators import quantile_map as qm
from meltemi.plans import roles
from meltemi.plans.mapping import apply_sql, fit_sql
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query
MEMBER = ["model", "scenario", "point"]
_M = ", ".join(MEMBER)


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


_DONE = f"done AS (SELECT {_M}, year FROM ens GROUP BY {_M}, year HAVING count(DISTINCT date) >= 100)"


def _complete(e):
    return e.join(ix.complete_years(e, MEMBER, "year", "date", 100), [*MEMBER, "year"], "left_semi")


@query("f13_complete_years", _sql(roles.ENS, body="SELECT model, scenario, year, count(DISTINCT date)::BIGINT AS n FROM ens GROUP BY 1, 2, 3 HAVING count(DISTINCT date) >= 340"))
def complete(spark, d):
    e = roles.ens(spark, d)
    years = ix.complete_years(e, ["model", "scenario"], "year", "date")
    return e.join(years, ["model", "scenario", "year"], "left_semi").groupBy("model", "scenario", "year").agg(F.count_distinct("date").alias("n"))


_STATS = {"annual_mean": "avg(tmean)", "annual_sum": "sum(precip)", "count_gt:35": "sum(CASE WHEN tmean > 35 THEN 1 ELSE 0 END)::DOUBLE", "count_lt:5": "sum(CASE WHEN tmean < 5 THEN 1 ELSE 0 END)::DOUBLE"}


@query("a11_annual_stat", _sql(roles.ENS, _DONE, body=f"SELECT {_M}, year, " + ", ".join(f"round({e} + 2e-7, 4) AS {n.replace(':', '_')}" for n, e in _STATS.items()) + f" FROM ens SEMI JOIN done USING ({_M}, year) GROUP BY {_M}, year"))
def annual_stat(spark, d):
    c = {"annual_sum": "precip"}
    return _complete(roles.ens(spark, d)).groupBy(*MEMBER, "year").agg(*[F.round(ix.annual_stat(n, F.col(c.get(n, "tmean"))) + 2e-7, 4).alias(n.replace(":", "_")) for n in _STATS])


_T = [f"coalesce(avg(CASE WHEN month(date) = {i} THEN tmean - 20 END), 0)" for i in range(1, 13)]
_PET = "pet AS (SELECT *, 6.75e-7 * i ** 3 - 7.71e-5 * i ** 2 + 1.792e-2 * i + 0.49239e0 AS a FROM (SELECT *, list_sum(list_transform(t, lambda x: CASE WHEN x > 0 THEN pow(greatest(x, 0) / 5, 1.514e0) ELSE 0 END)) AS i FROM (SELECT " + f"{_M}, year, sum(precip) AS p, [{', '.join(_T)}] AS t FROM ens GROUP BY {_M}, year)))"


@query("a12_aridity", _sql(roles.ENS, _PET, f"q AS (SELECT {_M}, year, p, list_sum(list_transform(t, lambda x: CASE WHEN x > 0 THEN 16 * pow(10 * greatest(x, 0) / nullif(i, 0), a) ELSE 0 END)) AS pet FROM pet)", body=f"SELECT {_M}, year, CASE WHEN pet > 0 THEN round(p / pet, 5) END AS aridity FROM q"))
def aridity(spark, d):
    e = roles.ens(spark, d).withColumn("tmean", F.col("tmean") - 20)
    return ix.aridity(e, [*MEMBER, "year"], "date", "tmean", "precip").withColumn("aridity", F.round("aridity", 5))


_HIST = "year BETWEEN 1995 AND 1997"
_THR = f"thr AS (SELECT {_M}, quantile_cont(CASE WHEN precip > 1 THEN precip END, 0.99) AS t FROM (SELECT * FROM ens SEMI JOIN done USING ({_M}, year)) WHERE {_HIST} GROUP BY {_M})"


def _thresholds(e):
    return e.where(_HIST).groupBy(*MEMBER).agg(F.percentile(F.when(F.col("precip") > 1, F.col("precip")), 0.99).alias("t"))


@query("a13_r99p_threshold", _sql(roles.ENS, _DONE, _THR, body=f"SELECT {_M}, round(t + 2e-7, 4) AS t FROM thr"))
def threshold(spark, d):
    return _thresholds(_complete(roles.ens(spark, d))).withColumn("t", F.round(F.col("t") + 2e-7, 4))


@query("a14_r99p_counts", _sql(roles.ENS, _DONE, _THR, body=f"SELECT {_M}, year, sum(CASE WHEN precip > t THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT * FROM ens SEMI JOIN done USING ({_M}, year)) JOIN thr USING ({_M}) GROUP BY {_M}, year"))
def counts(spark, d):
    e = _complete(roles.ens(spark, d))
    return e.join(_thresholds(e), MEMBER).groupBy(*MEMBER, "year").agg(F.sum(F.when(F.col("precip") > F.col("t"), 1).otherwise(0)).cast("long").alias("n"))


_YR = f"yr AS (SELECT {_M}, year, avg(tmean) AS v FROM ens SEMI JOIN done USING ({_M}, year) GROUP BY {_M}, year)"


def _yearly(e):
    return _complete(e).groupBy(*MEMBER, "year").agg(F.avg("tmean").alias("v"))


@query("a15_ensemble_mean", _sql(roles.ENS, _DONE, _YR, f"mm AS (SELECT {_M}, avg(v) AS v FROM yr GROUP BY {_M})", body="SELECT scenario, point, round(avg(v), 6) AS v FROM mm GROUP BY 1, 2"))
def ensemble(spark, d):
    out = ix.ensemble_mean(_yearly(roles.ens(spark, d)), ["scenario", "point"], "model", "v")
    return out.withColumn("v", r6(F.col("v")))


_PERIODS = {"historical": (1995, 1997), "near": (1998, 1999), "far": (2000, 2001)}
_PSQL = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in _PERIODS.items()) + " END"


@query("a16_period_pivot", _sql(roles.ENS, _DONE, _YR, f"pp AS (SELECT scenario, point, model, {_PSQL} AS period, avg(v) AS v FROM yr GROUP BY ALL)", "mm AS (SELECT scenario, point, period, avg(v) AS v FROM pp GROUP BY 1, 2, 3)", body="SELECT point, " + ", ".join(f"round(10 * max(CASE WHEN period = '{n}' AND scenario = '{s}' THEN v END), 5) AS {s.lower()}_{n}" for s in ("F", "O") for n in _PERIODS) + " FROM mm GROUP BY 1").replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def period_pivot(spark, d):
    p = None
    for n, (a, b) in _PERIODS.items():
        p = F.when(F.col("year").between(a, b), n) if p is None else p.when(F.col("year").between(a, b), n)
    e = ix.ensemble_mean(_yearly(roles.ens(spark, d)).withColumn("period", p), ["scenario", "point", "period"], "model", "v")
    cols = [F.round(10 * F.max(F.when((F.col("period") == n) & (F.col("scenario") == s), F.col("v"))), 5).alias(f"{s.lower()}_{n}") for s in ("F", "O") for n in _PERIODS]
    return e.groupBy("point").agg(*cols)


@query("a17_mean_annual", _sql(roles.ENS, body="SELECT point, round(avg(v), 6) AS v FROM (SELECT point, year, avg(tmean) AS v FROM ens GROUP BY 1, 2) GROUP BY 1"))
def mean_annual(spark, d):
    y = roles.ens(spark, d).groupBy("point", "year").agg(F.avg("tmean").alias("v"))
    return y.groupBy("point").agg(r6(F.avg("v")).alias("v"))


@query("a18_days_above", _sql(roles.ENS, body="SELECT point, round(avg(n), 6) AS days FROM (SELECT point, year, sum(CASE WHEN tmean > 35 THEN 1 ELSE 0 END)::DOUBLE AS n FROM ens GROUP BY 1, 2) GROUP BY 1"))
def days_above(spark, d):
    y = roles.ens(spark, d).groupBy("point", "year").agg(F.sum(F.when(F.col("tmean") > 35, 1.0).otherwise(0.0)).alias("n"))
    return y.groupBy("point").agg(r6(F.avg("n")).alias("days"))


def _series(spark, d):
    return roles.ens(spark, d).select("model", "scenario", "point", "date", F.least(F.dayofyear("date"), F.lit(365)).alias("doy"), F.when(F.col("year") <= 1998, "cal").otherwise("fut").alias("period"), F.col("tmean").alias("obs"), (F.col("tmean") * 0.7 + F.col("precip") * 0.2).alias("mdl"))


_S = "s AS (SELECT model, scenario, point, date, least(dayofyear(date), 365)::INT AS doy, CASE WHEN year <= 1998 THEN 'cal' ELSE 'fut' END AS period, tmean AS obs, tmean * 0.7e0 + precip * 0.2e0 AS mdl FROM ens)"
_W = "win AS (SELECT a.model, a.scenario, a.point, c.doy AS centre, a.obs, a.mdl FROM s a JOIN (SELECT DISTINCT model, scenario, point, doy FROM s) c ON a.model = c.model AND a.scenario = c.scenario AND a.point = c.point AND least(abs(a.doy - c.doy), 365 - abs(a.doy - c.doy)) <= 15 WHERE a.period = 'cal')"


@query("n05_eqm_grid", _sql(roles.ENS, _S, "cal AS (SELECT scenario, point, (doy // 92)::INT AS season, obs, mdl FROM s WHERE period = 'cal')", fit_sql("t", "cal", "scenario, point, season", 40, precip=False), body="SELECT scenario, point, season, i::INT AS i, round(mq[i + 1] + 2e-9, 6) AS mq, round(oq[i + 1] + 2e-9, 6) AS oq FROM t, range(0, 40) r(i)"))
def eqm_grid(spark, d):
    s = _series(spark, d).where("period = 'cal'").withColumn("season", F.expr("cast(doy div 92 as int)"))
    t = qm.fit(s, ["scenario", "point", "season"], n=40)
    return t.select("scenario", "point", "season", F.posexplode(F.arrays_zip("mq", "oq")).alias("i", "q")).select("scenario", "point", "season", "i", r6(F.col("q.mq") + 2e-9).alias("mq"), r6(F.col("q.oq") + 2e-9).alias("oq"))


@query("n11_projection_eqm", _sql(roles.ENS, _S, _W, fit_sql("t", "win", "model, scenario, point, centre", 250, precip=False), body=f"SELECT s.model, s.scenario, s.point, s.date, round({apply_sql('mdl', False)}, 5) AS corrected FROM s LEFT JOIN t ON s.model = t.model AND s.scenario = t.scenario AND s.point = t.point AND s.doy = t.centre"))
def projection(spark, d):
    out = qm.projection(_series(spark, d), MEMBER)
    return out.select(*MEMBER, "date", F.round("corrected", 5).alias("corrected"))


@query("n11_ensemble")
def ensemble(spark, d):
    """Temperature and precipitation of every member, scenario and point corrected against the stations of its point."""
    e = roles.ens(spark, d).withColumn("doy", F.least(F.dayofyear("date"), F.lit(365)))
    short = F.col("model") == "N"
    native = F.when(short, F.least(((F.month("date") - 1) * 30 + F.least(F.day("date"), F.lit(30))), F.lit(360))).otherwise(F.col("doy"))
    e = e.withColumns({"scenario": F.when(F.col("scenario") == "F", "historical").otherwise(F.col("scenario")), "doy": native, "calendar": F.when(short, "360_day").otherwise("standard"), "calibrating": F.col("year") <= 1997})
    o = roles.obs(spark, d).where("year(date) <= 1997").withColumn("point", F.col("station_id") % 5)
    o = o.groupBy("point", "date").agg(F.avg("obs_tmean").alias("tmean"), F.avg("obs_prcp").alias("precip")).withColumn("doy", F.least(F.dayofyear("date"), F.lit(365)))
    return qm.ensemble(o, e).select("model", "scenario", "point", "date", *[F.round(c, 5).alias(c) for c in ("tmean", "precip")])

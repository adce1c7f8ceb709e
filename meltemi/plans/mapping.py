"""Quantile mapping: fitting, applying, seasons, blends and leave-one-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions.calendar import centres, centres_within, nearest_centre
from meltemi.functions.numeric import quantile, r6
from meltemi.operators import order
from meltemi.operators import quantile_map as qm
from meltemi.plans import roles
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query
_DONOR = roles.donor_sql(0, "donor")
_TARGET = roles.donor_sql(1, "target")
_CENTRES = "centres AS (SELECT unnest(range(1, 367, 30))::INT AS centre)"


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def _q(a: str, p: str) -> str:
    """Linear quantile p of the ascending list a."""
    at = f"(({p}) * (len({a}) - 1))"
    i = f"CAST(floor({at}) AS INT)"
    return f"({a}[{i} + 1] + ({a}[least({i} + 2, len({a}))] - {a}[{i} + 1]) * ({at} - {i}))"


def fit_sql(name: str, source: str, keys: str, n: int, precip: bool = True, wet: float = 0.1) -> str:
    """CTEs of the transfers of `source` (keys, obs, mdl), the last one called name."""
    thr = f"CASE WHEN n_wet > 0 THEN coalesce({_q('m0', '1 - n_wet / n_rows')}, 0) ELSE 0 END" if precip else "0::DOUBLE"
    keep = f"list_filter(o0, lambda v: v > {wet}) AS o, list_filter(m0, lambda v: v > wet_thr) AS m" if precip else "o0 AS o, m0 AS m"
    steps = f"list_transform(range(0, {n}), lambda i: i::DOUBLE / {n - 1})"
    ramp = f"list_transform({steps}, lambda p: lo + (hi - lo) * p)"
    return (
        f"{name}_a AS (SELECT {keys}, list_sort(list(obs) FILTER (obs IS NOT NULL)) AS o0, list_sort(list(mdl) FILTER (mdl IS NOT NULL)) AS m0, avg(obs) AS obs_mean, avg(mdl) AS mdl_mean, count(CASE WHEN obs > {wet} THEN 1 END)::DOUBLE AS n_wet, count(obs)::DOUBLE AS n_rows FROM {source} GROUP BY {keys}), "
        f"{name}_b AS (SELECT *, {thr} AS wet_thr FROM {name}_a), {name}_c AS (SELECT *, {keep} FROM {name}_b), "
        f"{name}_d AS (SELECT *, coalesce(list_min(list_concat(o, m)), 0) AS lo, coalesce(list_max(list_concat(o, m)), 1) AS hi, len(o) < 2 OR len(m) < 2 AS few FROM {name}_c), "
        f"{name} AS (SELECT {keys}, CASE WHEN few THEN {ramp} ELSE list_transform({steps}, lambda p: {_q('m', 'p')}) END AS mq, CASE WHEN few THEN {ramp} ELSE list_transform({steps}, lambda p: {_q('o', 'p')}) END AS oq, obs_mean, mdl_mean, wet_thr, n_wet FROM {name}_d)"
    )


def apply_sql(x: str, precip: bool = True) -> str:
    k = f"len(list_filter(mq, lambda v: v <= {x}))"
    inside = f"CASE WHEN {k} = len(mq) THEN oq[len(oq)] ELSE oq[{k}] + (oq[{k} + 1] - oq[{k}]) * ({x} - mq[{k}]) / (mq[{k} + 1] - mq[{k}]) END"
    y = f"CASE WHEN {x} < mq[1] OR {x} > mq[len(mq)] THEN {x} + obs_mean - mdl_mean ELSE {inside} END"
    return f"CASE WHEN {x} <= wet_thr THEN 0 ELSE greatest({y}, 0) END" if precip else y


_DIST = "least(abs({a} - {b}), 366 - abs({a} - {b}))"
_NEAR = f"near AS (SELECT centre, obs, mdl FROM donor JOIN centres ON {_DIST.format(a='doy', b='centre')} <= 45)"


def _seasonal_sql(x: str, source: str, body: str, donors: str = "donor", extra: str = "") -> str:
    pick = f"picked AS (SELECT t.*, (SELECT arg_min(centre, {_DIST.format(a='t.doy', b='centre')} * 1000 + centre) FROM centres) AS centre FROM {source} t)"
    near = f"near AS (SELECT centre, obs, mdl FROM {donors} JOIN centres ON {_DIST.format(a='doy', b='centre')} <= 45)"
    used = "used AS (SELECT p.*, coalesce(b.mq, w.mq) AS mq, coalesce(b.oq, w.oq) AS oq, coalesce(b.obs_mean, w.obs_mean) AS obs_mean, coalesce(b.mdl_mean, w.mdl_mean) AS mdl_mean, coalesce(b.wet_thr, w.wet_thr) AS wet_thr FROM picked p LEFT JOIN (SELECT * FROM by_centre WHERE n_wet >= 30) b USING (centre), whole w)"
    keyed = f"keyed AS (SELECT 1 AS k, obs, mdl FROM {donors})"
    return _sql(*([extra] if extra else []), _CENTRES, near, fit_sql("by_centre", "near", "centre", 200), keyed, fit_sql("whole", "keyed", "k", 200), pick, used, body=body.format(y=apply_sql(x)))


@query("j15_doy_window", _sql(_DONOR, _CENTRES, _NEAR, body="SELECT centre, count(*)::BIGINT AS n, round(avg(obs), 6) AS obs_mean, round(avg(mdl), 6) AS mdl_mean FROM near GROUP BY 1"))
def doy_window(spark, d):
    near = roles.donor(spark, d, 0).withColumn("centre", F.explode(centres_within(F.col("doy"), centres(), 45, 366)))
    return near.groupBy("centre").agg(F.count("*").alias("n"), r6(F.avg("obs")).alias("obs_mean"), r6(F.avg("mdl")).alias("mdl_mean"))


@query("j16_nearest_centre", _sql(_TARGET, _CENTRES, f"n AS (SELECT doy, arg_min(centre, {_DIST.format(a='doy', b='centre')} * 1000 + centre) AS centre FROM (SELECT DISTINCT doy FROM target), centres GROUP BY 1)", body="SELECT id, doy, centre::INT AS centre FROM target JOIN n USING (doy)"))
def nearest(spark, d):
    """The centre of season of every target day."""
    return roles.donor(spark, d, 1).select("id", "doy", nearest_centre(F.col("doy"), centres(), 366).alias("centre"))


@query("a20_iqr", _sql(_DONOR, body="SELECT id, round(quantile_cont(mdl, 0.75) - quantile_cont(mdl, 0.25) + 2e-9, 6) AS iqr FROM donor GROUP BY 1"))
def iqr(spark, d):
    q = F.percentile("mdl", F.array(F.lit(0.25), F.lit(0.75)))
    return roles.donor(spark, d, 0).groupBy("id").agg(q.alias("q")).select("id", r6(F.get("q", F.lit(1)) - F.get("q", F.lit(0)) + 2e-9).alias("iqr"))


@query("a21_quantile_vector", _sql(_DONOR, body=f"SELECT id, i::INT AS i, round({_q('m', 'i::DOUBLE / 20')} + 2e-9, 6) AS q FROM (SELECT id, list_sort(list(mdl)) AS m FROM donor GROUP BY 1), range(0, 21) t(i)"))
def quantile_vector(spark, d):
    g = order.levels(order.ranked(roles.donor(spark, d, 0), ["id"], "mdl"), ["id"], 21, "m")
    return g.select("id", F.posexplode("m").alias("i", "q")).withColumn("q", r6(F.col("q") + 2e-9))


@query("a22_dynamic_quantile", _sql(_DONOR, body=f"SELECT id, round({_q('m', '1 - wet')}, 6) AS thr FROM (SELECT id, list_sort(list(mdl)) AS m, avg(CASE WHEN obs > 0.1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS wet FROM donor GROUP BY 1)"))
def dynamic_quantile(spark, d):
    g = roles.donor(spark, d, 0).groupBy("id").agg(F.array_sort(F.collect_list("mdl")).alias("m"), F.avg(F.when(F.col("obs") > 0.1, 1.0).otherwise(0.0)).alias("wet"))
    return g.select("id", r6(quantile(F.col("m"), 1 - F.col("wet"))).alias("thr"))


@query("a23_wet_fraction", _sql(_DONOR, body="SELECT id, round(avg(CASE WHEN obs > 0.1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS wet FROM donor GROUP BY 1"))
def wet_fraction(spark, d):
    return roles.donor(spark, d, 0).groupBy("id").agg(r6(F.avg(F.when(F.col("obs") > 0.1, 1.0).otherwise(0.0))).alias("wet"))


_ROUND = "round(obs_mean, 6) AS obs_mean, round(mdl_mean, 6) AS mdl_mean, round(wet_thr, 6) AS wet_thr"


@query("n01_fit_eqm", _sql(_DONOR, fit_sql("t", "donor", "id", 50), body=f"SELECT id, i::INT AS i, round(mq[i + 1], 6) AS mq, round(oq[i + 1], 6) AS oq, {_ROUND} FROM t, range(0, 50) r(i)"))
def fit(spark, d):
    t = qm.fit(roles.donor(spark, d, 0), ["id"], n=50, precip=True)
    t = t.select("id", F.posexplode(F.arrays_zip("mq", "oq")).alias("i", "q"), *[r6(F.col(c)).alias(c) for c in ("obs_mean", "mdl_mean", "wet_thr")])
    return t.select("id", "i", r6(F.col("q.mq")).alias("mq"), r6(F.col("q.oq")).alias("oq"), "obs_mean", "mdl_mean", "wet_thr")


@query("n02_apply_eqm", _sql(_DONOR, _TARGET, "months AS (SELECT (doy % 4)::INT AS season, obs, mdl FROM donor)", fit_sql("t", "months", "season", 100), body=f"SELECT id, doy, round(mdl, 6) AS mdl, round({apply_sql('mdl')}, 6) AS mapped FROM target JOIN t ON (doy % 4)::INT = season"))
def apply(spark, d):
    t = qm.fit(roles.donor(spark, d, 0).withColumn("season", F.col("doy") % 4), ["season"], n=100, precip=True)
    x = roles.donor(spark, d, 1).withColumn("season", F.col("doy") % 4).join(t, "season")
    return x.select("id", "doy", r6(F.col("mdl")).alias("mdl"), r6(qm.applied(F.col("mdl"), True)).alias("mapped"))


@query("n07_seasonal_qm", _seasonal_sql("mdl", "target", "SELECT id, doy, round(mdl, 6) AS mdl, round({y}, 6) AS mapped FROM used", extra=f"{_DONOR}, {_TARGET}"))
def seasonal(spark, d):
    out = qm.seasonal(roles.donor(spark, d, 1), roles.donor(spark, d, 0), "mdl", "mapped")
    return out.select("id", "doy", r6(F.col("mdl")).alias("mdl"), r6(F.col("mapped")).alias("mapped"))


@query("n08_blend", _seasonal_sql("mdl", "target", "SELECT id, doy, round(greatest(0.6e0 * ({y}) + (1 - 0.6e0) * (mdl * 0.8e0), 0), 6) AS blended FROM used", extra=f"{_DONOR}, {_TARGET}"))
def blend(spark, d):
    out = qm.seasonal(roles.donor(spark, d, 1), roles.donor(spark, d, 0), "mdl", "mapped")
    return out.select("id", "doy", r6(qm.blend(F.col("mapped"), F.col("mdl") * 0.8)).alias("blended"))


_FOLDS = "(SELECT DISTINCT id AS fold FROM donor)"


@query("j21_loo_donors", _sql(_DONOR, body=f"SELECT fold, count(*)::BIGINT AS n, round(avg(obs), 6) AS obs_mean FROM donor d, {_FOLDS} f WHERE d.id <> f.fold GROUP BY 1"))
def loo(spark, d):
    return qm.without_each(roles.donor(spark, d, 0), "id", roles.donor(spark, d, 0).select("id").distinct())


@query("n10_loo_qm", _sql(_DONOR, f"pool AS (SELECT fold, obs, mdl FROM donor d, {_FOLDS} f WHERE d.id <> f.fold)", fit_sql("t", "pool", "fold", 100), body=f"SELECT id, doy, round(mdl, 6) AS mdl, round({apply_sql('mdl')}, 6) AS mapped FROM donor JOIN t ON id = fold"))
def loo_mapping(spark, d):
    out = qm.leave_one_out(roles.donor(spark, d, 0), "id", roles.donor(spark, d, 0).select("id").distinct(), n=100)
    return out.select("id", "doy", r6(F.col("mdl")).alias("mdl"), r6(F.col("mapped")).alias("mapped"))


def _gamma_table() -> tuple[list[float], list[float], list[float]]:
    from meltemi.functions.gamma import table

    return table()


def _gamma_sql() -> str:
    k, r, p = ([repr(round(float(v), 12)) + "::DOUBLE" for v in x] for x in _gamma_table())
    xs, ks, ps = (f"[{', '.join(v)}]" for v in (list(reversed(r)), list(reversed(k)), list(reversed(p))))
    at = "len(list_filter(xs, lambda v: v <= x))"
    interp = lambda ys, x: f"CASE WHEN {at} = 0 THEN {ys}[1] WHEN {at} = len(xs) THEN {ys}[len(xs)] ELSE {ys}[{at}] + ({ys}[{at} + 1] - {ys}[{at}]) * (x - xs[{at}]) / (xs[{at} + 1] - xs[{at}]) END"
    return _sql(roles.OBS, f"tab AS (SELECT {xs} AS xs, {ks} AS ks, {ps} AS ps)", f"v AS (SELECT station_id, date, obs_prcp AS p50, obs_prcp * (1 + obs_wind / 4) AS p90 FROM obs)", "w AS (SELECT *, CASE WHEN p50 > 0 AND p90 > p50 THEN p90 / p50 END AS x FROM v, tab)", f"z AS (SELECT *, {interp('ks', 'x')} AS k, {interp('ps', 'x')} AS q FROM w WHERE x IS NOT NULL)", body="SELECT station_id, date, round(k * p50 / q + 2e-7, 4) AS mean FROM z UNION ALL SELECT station_id, date, round(p50 + 2e-7, 4) FROM w WHERE x IS NULL")


@query("p21_gamma_mean", _gamma_sql())
def gamma_mean(spark, d):
    from meltemi.functions.gamma import conditional_mean

    o = roles.obs(spark, d)
    p50, p90 = F.col("obs_prcp"), F.col("obs_prcp") * (1 + F.col("obs_wind") / 4)
    return o.select("station_id", "date", F.round(conditional_mean(p50, p90) + 2e-7, 4).alias("mean"))

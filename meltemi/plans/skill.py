"""Indices, skill scores and their pooled and pivoted reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.functions.numeric import event, r6
from meltemi.operators import order
from meltemi.operators.indices import EVENTS, aridities, period_indices, r99p_threshold
from meltemi.operators.skill import contingency, continuous, extreme_weight, matched, pooled
from meltemi.plans import roles
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query
_THR = "thr AS (SELECT station_id, CASE WHEN count(CASE WHEN obs_prcp > 1 THEN 1 END) > 10 THEN quantile_cont(CASE WHEN obs_prcp > 1 THEN obs_prcp END, 0.99) ELSE 999.0 END AS r99p_threshold FROM obs GROUP BY 1)"
_SOURCES = ("obs", "pred", "base")


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def _with_threshold(spark, d) -> DataFrame:
    o = roles.obs(spark, d)
    # One row for each station; Spark broadcasts it only where its measured size is small.
    thr = o.groupBy("station_id").agg(r99p_threshold(F.col("obs_prcp")).alias("r99p_threshold"))
    return o.join(thr, "station_id").withColumn("year", F.year("date")).withColumn("month", F.month("date"))


def _aggs() -> list[tuple[str, str]]:
    out = []
    for s in _SOURCES:
        out += [(f"{s}_{v}", f"round(avg({s}_{v}) + 2e-9, 6)") for v in ("tmean", "tmin", "tmax", *(["wind"] if s == "obs" else []))]
        out.append((f"{s}_precip", f"round(sum({s}_prcp) + 2e-7, 4)"))
        for name, (v, op, thr) in EVENTS.items():
            out.append((f"{s}_{name}", f"sum(CASE WHEN {s}_{v} {op} {'r99p_threshold' if thr is None else thr} THEN 1 ELSE 0 END)::BIGINT"))
    return out


def _rounded(df: DataFrame) -> DataFrame:
    """Rounded a little above half, as many of these means and sums are exact ties of the decimal system."""
    return df.select(*[F.round(F.col(c) + (2e-7 if c.endswith("_precip") else 2e-9), 4 if c.endswith("_precip") else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_INDEX = ", ".join(f"{e} AS {c}" for c, e in _aggs())


@query("a09_annual_indices", _sql(roles.OBS, _THR, body=f"SELECT station_id, year(date)::INT AS year, {_INDEX} FROM obs JOIN thr USING (station_id) GROUP BY 1, 2"))
def annual(spark, d):
    return _rounded(period_indices(_with_threshold(spark, d), ["station_id", "year"]))


@query("a10_monthly_indices", _sql(roles.OBS, _THR, body=f"SELECT station_id, year(date)::INT AS year, month(date)::INT AS month, {_INDEX} FROM obs JOIN thr USING (station_id) GROUP BY 1, 2, 3"))
def monthly(spark, d):
    return _rounded(period_indices(_with_threshold(spark, d), ["station_id", "year", "month"]))


def _cont(o: str, p: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND var_pop({o}) * count(*) > 1e-12 THEN round(1 - sum(({p} - {o}) * ({p} - {o})) / (var_pop({o}) * count(*)), 6) END AS R2, CASE WHEN count(*) >= 3 THEN round(sqrt(avg(({p} - {o}) * ({p} - {o}))), 6) END AS RMSE, CASE WHEN count(*) >= 3 THEN round(avg({p} - {o}), 6) END AS Bias, count(*)::BIGINT AS n"


_R = ("R2", "RMSE", "Bias")


def _rounded_scores(df: DataFrame, names=_R) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


@query("a24_skill_continuous", _sql(roles.OBS, body=f"SELECT station_id, {_cont('obs_tmax', 'pred_tmax')} FROM obs GROUP BY 1"))
def skill(spark, d):
    return _rounded_scores(roles.obs(spark, d).groupBy("station_id").agg(*continuous(F.col("obs_tmax"), F.col("pred_tmax"))))


def _cont_sql(o: str, p: str) -> str:
    h, m, f = (f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in (f"{o} AND {p}", f"{o} AND NOT {p}", f"NOT {o} AND {p}"))
    r = lambda a, b: f"round({a}::DOUBLE / nullif({b}, 0)::DOUBLE, 6)"
    return f"{r(h, f'({h} + {m})')} AS POD, {r(f, f'({h} + {f})')} AS FAR, {r(h, f'({h} + {m} + {f})')} AS CSI, {h}::BIGINT AS H, {m}::BIGINT AS M, {f}::BIGINT AS F, ({h} + {m})::BIGINT AS n_obs_events"


@query("a25_contingency", _sql(roles.OBS, body=f"SELECT station_id, {_cont_sql('obs_prcp > 20', 'pred_prcp > 20')} FROM obs GROUP BY 1"))
def table(spark, d):
    o = matched(roles.obs(spark, d), "obs_prcp", "pred_prcp", "base_prcp")
    return _rounded_scores(o.groupBy("station_id").agg(*contingency(F.col("obs_prcp") > 20, F.col("pred_prcp") > 20)), ("POD", "FAR", "CSI"))


_ALL = "coalesce(CAST(station_id AS VARCHAR), 'ALL') AS station_id"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT station_id, '{v}' AS index, obs_{v} AS o, pred_{v} AS p FROM ann" for v in ("tmean", "tmax", "tmin", "pr20", "tmax35")) + ")"
_ANN = "ann AS (SELECT station_id, year(date)::INT AS year, avg(obs_tmean) AS obs_tmean, avg(pred_tmean) AS pred_tmean, avg(obs_tmax) AS obs_tmax, avg(pred_tmax) AS pred_tmax, avg(obs_tmin) AS obs_tmin, avg(pred_tmin) AS pred_tmin, sum(CASE WHEN obs_prcp > 20 THEN 1 ELSE 0 END)::DOUBLE AS obs_pr20, sum(CASE WHEN pred_prcp > 20 THEN 1 ELSE 0 END)::DOUBLE AS pred_pr20, sum(CASE WHEN obs_tmax > 35 THEN 1 ELSE 0 END)::DOUBLE AS obs_tmax35, sum(CASE WHEN pred_tmax > 35 THEN 1 ELSE 0 END)::DOUBLE AS pred_tmax35 FROM obs GROUP BY 1, 2)"


def _long(df: DataFrame, names=("tmean", "tmax", "tmin", "pr20", "tmax35")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("index"), F.col(f"obs_{v}").cast("double").alias("o"), F.col(f"pred_{v}").cast("double").alias("p")) for v in names])
    return df.withColumn("_x", F.explode(pairs)).select("*", "_x.*").drop("_x")


@query("a26_pooled", _sql(roles.OBS, _ANN, _LONG, body=f"SELECT {_ALL}, index, {_cont('o', 'p')} FROM long GROUP BY GROUPING SETS ((station_id, index), (index))"))
def pooled_scores(spark, d):
    a = _long(period_indices(_with_threshold(spark, d), ["station_id", "year"]))
    return _rounded_scores(pooled(a, "station_id", ["index"], continuous(F.col("o"), F.col("p"))))


_GROUPS = "grp AS (SELECT s_suppkey AS station_id, r_name AS grp FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
_MON = "mon AS (SELECT station_id, year(date)::INT AS year, month(date)::INT AS month, avg(obs_tmean) AS obs_tmean, avg(pred_tmean) AS pred_tmean, avg(obs_tmax) AS obs_tmax, avg(pred_tmax) AS pred_tmax FROM obs GROUP BY 1, 2, 3)"
_ML = "ml AS (SELECT station_id, 'tmean' AS index, obs_tmean AS o, pred_tmean AS p FROM mon UNION ALL SELECT station_id, 'tmax', obs_tmax, pred_tmax FROM mon)"


@query("a27_median_pivot", _sql(roles.OBS, _MON, _ML, _GROUPS, f"sc AS (SELECT station_id, index, {_cont('o', 'p')} FROM ml GROUP BY 1, 2)", body="SELECT grp, round(median(CASE WHEN index = 'tmean' THEN R2 END), 5) AS tmean, round(median(CASE WHEN index = 'tmax' THEN R2 END), 5) AS tmax FROM sc JOIN grp USING (station_id) GROUP BY 1"))
def median_pivot(spark, d):
    m = _long(period_indices(_with_threshold(spark, d), ["station_id", "year", "month"]), ("tmean", "tmax"))
    sc = _rounded_scores(m.groupBy("station_id", "index").agg(*continuous(F.col("o"), F.col("p"))))
    g = roles.table(spark, d, "supplier").join(roles.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(roles.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = g.select(F.col("s_suppkey").alias("station_id"), F.col("r_name").alias("grp"))
    return sc.join(g, "station_id").groupBy("grp").pivot("index", ["tmean", "tmax"]).agg(F.round(F.median("R2"), 5))


@query("a28_summary", _sql(roles.OBS, body="SELECT round(min(obs_tmax), 6) AS lo, round(avg(obs_tmax), 6) AS mean, round(max(obs_tmax), 6) AS hi, round(avg(obs_prcp), 6) AS prcp FROM obs"))
def summary(spark, d):
    return roles.obs(spark, d).agg(r6(F.min("obs_tmax")).alias("lo"), r6(F.avg("obs_tmax")).alias("mean"), r6(F.max("obs_tmax")).alias("hi"), r6(F.avg("obs_prcp")).alias("prcp"))


_SOURCES = ("obs", "pred", "base")


def _aridity_sql() -> str:
    sources = " UNION ALL ".join(f"SELECT station_id, date, '{s}' AS source, {s}_tmean - 20 AS tmean, {s}_prcp AS precip FROM obs" for s in _SOURCES)
    t = ", ".join(f"coalesce(avg(CASE WHEN month(date) = {i} THEN tmean END), 0)" for i in range(1, 13))
    return _sql(
        roles.OBS,
        f"long AS ({sources})",
        f"m AS (SELECT station_id, year(date)::INT AS year, source, sum(precip) AS p, [{t}] AS t FROM long GROUP BY 1, 2, 3)",
        "h AS (SELECT *, list_sum(list_transform(t, lambda x: CASE WHEN x > 0 THEN pow(greatest(x, 0) / 5, 1.514e0) ELSE 0 END)) AS i FROM m)",
        "e AS (SELECT *, 6.75e-7 * i ** 3 - 7.71e-5 * i ** 2 + 1.792e-2 * i + 0.49239e0 AS a FROM h)",
        "q AS (SELECT *, list_sum(list_transform(t, lambda x: CASE WHEN x > 0 THEN 16 * pow(10 * greatest(x, 0) / nullif(i, 0), a) ELSE 0 END)) AS pet FROM e)",
        body="SELECT station_id, year, " + ", ".join(f"round(max(CASE WHEN source = '{s}' AND pet > 0 THEN p / pet END), 5) AS {s}_aridity" for s in _SOURCES) + " FROM q GROUP BY 1, 2",
    )


@query("a09_aridity_sources", _aridity_sql())
def aridity_sources(spark, d):
    """Annual aridity of observations, predictions and baseline."""
    o = roles.obs(spark, d).withColumns({f"{s}_tmean": F.col(f"{s}_tmean") - 20 for s in _SOURCES}).withColumn("year", F.year("date"))
    out = aridities(o, ["station_id", "year"], "date", {s: (f"{s}_tmean", f"{s}_prcp") for s in _SOURCES})
    return out.select("station_id", "year", *[F.round(f"{s}_aridity", 5).alias(f"{s}_aridity") for s in _SOURCES])


@query("a29_levels", _sql(roles.OBS, body="SELECT month(date)::INT AS month, round(least(0, quantile_cont(obs_tmin, 0.02)), 6) AS lo, round(quantile_cont(obs_tmin, 0.98), 6) AS hi FROM obs GROUP BY 1"))
def levels(spark, d):
    q = F.percentile("obs_tmin", F.array(F.lit(0.02), F.lit(0.98)))
    return roles.obs(spark, d).groupBy(F.month("date").alias("month")).agg(q.alias("q")).select("month", r6(F.least(F.lit(0.0), F.get("q", F.lit(0)))).alias("lo"), r6(F.get("q", F.lit(1))).alias("hi"))


@query("a31_extreme_weight", _sql(roles.OBS, "p AS (SELECT quantile_cont(obs_prcp, 0.95) AS p95 FROM obs WHERE obs_prcp > 0.1)", body="SELECT station_id, date, CASE WHEN obs_prcp > p95 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM obs, p"))
def extremes(spark, d):
    o = roles.obs(spark, d)
    p95 = order.at_level(order.ranked(o.where("obs_prcp > 0.1"), [], "obs_prcp"), [], 0.95, "p95")
    return o.join(F.broadcast(p95)).select("station_id", "date", extreme_weight(F.col("obs_prcp"), F.col("p95")).alias("weight"))


_EV = {"wet_1mm": ("prcp", ">", 1.0), **{k: v for k, v in EVENTS.items() if v[2] is not None}}


def flagship(spark, d) -> DataFrame:
    """Per station and pooled: POD, FAR and CSI of every event, predictions and baseline side by side."""
    o = matched(roles.obs(spark, d), "obs_prcp", "pred_prcp", "base_prcp")
    # One scan and one shuffle: the events are exploded from a row, not read again for each.
    pairs = F.array(*[F.struct(F.lit(n).alias("event"), F.lit(s).alias("source"), event(F.col(f"obs_{v}"), op, t).alias("o"), event(F.col(f"{s}_{v}"), op, t).alias("p")) for n, (v, op, t) in _EV.items() for s in ("pred", "base")])
    long = o.select("station_id", F.explode(pairs).alias("_x")).select("station_id", "_x.*")
    return _rounded_scores(pooled(long, "station_id", ["event", "source"], contingency(F.col("o"), F.col("p"))), ("POD", "FAR", "CSI"))


_FL = "fl AS (" + " UNION ALL ".join(f"SELECT station_id, '{n}' AS event, '{s}' AS source, obs_{v} {op} {t} AS o, {s}_{v} {op} {t} AS p FROM obs" for n, (v, op, t) in _EV.items() for s in ("pred", "base")) + ")"
QUERIES["flagship_events"] = (flagship, _sql(roles.OBS, _FL, body=f"SELECT {_ALL}, event, source, {_cont_sql('o', 'p')} FROM fl GROUP BY GROUPING SETS ((station_id, event, source), (event, source))"))

"""Training rows, folds and the daily product."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions import weather as wx
from meltemi.functions.numeric import r6
from meltemi.operators import downscale as ds
from meltemi.operators import zones
from meltemi.plans import roles, zonal
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


_CERRA = "cerra AS (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, avg(greatest(l_extendedprice / 1000 - 30, 0)) AS cerra_precip, avg(l_quantity + l_tax * 20) AS obs_tmax, avg(l_tax * 50) AS cerra_wind, avg(l_tax * 120) AS cerra_gust, avg(l_discount * 40 - 2) AS cerra_u10, avg(2 - l_tax * 40) AS cerra_v10 FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2)"
_GEO = "geo AS (SELECT station_id, elevation_m, northness AS dem_northness, coast_km / 10 AS dem_eastness, elevation_m * 0.8e0 + 3 AS cerra_elev_m, lat FROM stations)"


def _cerra(spark, d):
    """Predictors of station days, of part of the observed ones; obs_tmax stands on both sides."""
    rows = roles.table(spark, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"))
    e = {
        "cerra_precip": "avg(greatest(l_extendedprice / 1000 - 30, 0))",
        "obs_tmax": "avg(l_quantity + l_tax * 20)",
        "cerra_wind": "avg(l_tax * 50)",
        "cerra_gust": "avg(l_tax * 120)",
        "cerra_u10": "avg(l_discount * 40 - 2)",
        "cerra_v10": "avg(2 - l_tax * 40)",
    }
    return rows.agg(*[F.expr(x).alias(c) for c, x in e.items()])


def _geo(spark, d):
    s = roles.stations(spark, d)
    return s.select("station_id", "elevation_m", F.col("northness").alias("dem_northness"), (F.col("coast_km") / 10).alias("dem_eastness"), (F.col("elevation_m") * 0.8 + 3).alias("cerra_elev_m"), "lat")


@query("j01_obs_predictors", _sql(roles.OBS, _CERRA, body="SELECT o.station_id, o.date, round(o.obs_tmax, 6) AS obs_tmax, round(c.obs_tmax, 6) AS obs_tmax_cerra, round(cerra_precip + 2e-9, 6) AS cerra_precip FROM obs o JOIN cerra c USING (station_id, date)"))
def obs_predictors(spark, d):
    out = ds.with_predictors(roles.obs(spark, d), _cerra(spark, d))
    return out.select("station_id", "date", r6(F.col("obs_tmax")).alias("obs_tmax"), r6(F.col("obs_tmax_cerra")).alias("obs_tmax_cerra"), r6(F.col("cerra_precip") + 2e-9).alias("cerra_precip"))


@query("j07_donor_pairs", _sql(roles.OBS, _CERRA, body="SELECT o.station_id, o.date, dayofyear(o.date)::INT AS doy, round(obs_prcp + 2e-9, 6) AS obs, round(cerra_precip + 2e-9, 6) AS mdl FROM obs o JOIN cerra c USING (station_id, date)"))
def donor_pairs(spark, d):
    out = ds.donor_pairs(roles.obs(spark, d), _cerra(spark, d), "obs_prcp", "cerra_precip")
    return out.select("station_id", "date", "doy", r6(F.col("obs") + 2e-9).alias("obs"), r6(F.col("mdl") + 2e-9).alias("mdl"))


@query("j09_fold_result", _sql(roles.OBS, _CERRA, body="SELECT o.station_id, o.date, round(o.obs_tmax, 6) AS obs_tmax, round(p.pred_tmax, 6) AS pred_tmax, round(c.cerra_precip + 2e-9, 6) AS cerra_precip FROM obs o JOIN (SELECT station_id, date, pred_tmax FROM obs WHERE month(date) > 2) p USING (station_id, date) LEFT JOIN cerra c USING (station_id, date)"))
def fold_result(spark, d):
    o = roles.obs(spark, d)
    p = o.where("month(date) > 2").select("station_id", "date", "pred_tmax")
    out = ds.fold_result(o.select("station_id", "date", "obs_tmax"), p, _cerra(spark, d).select("station_id", "date", "cerra_precip"))
    return out.select("station_id", "date", *[r6(F.col(c)).alias(c) for c in ("obs_tmax", "pred_tmax")], r6(F.col("cerra_precip") + 2e-9).alias("cerra_precip"))


_TRAIN = """
SELECT o.station_id, o.date, round(c.obs_tmax, 6) AS obs_tmax_cerra, round(sin(2 * pi() * month(o.date) / 12) + 2e-9, 6) AS month_sin, round(g.elevation_m - g.cerra_elev_m, 6) AS delta_elev_m,
  round((g.elevation_m - g.cerra_elev_m) * ([-4.5e0,-4.8e0,-5.2e0,-5.5e0,-5.8e0,-6.2e0,-6.5e0,-6.5e0,-6.0e0,-5.5e0,-5.0e0,-4.7e0])[month(o.date)] / 1000, 6) AS lapse_correction_c,
  round(CASE WHEN cerra_wind = 0 THEN 1 ELSE least(10, greatest(1, cerra_gust / cerra_wind)) END + 2e-9, 6) AS gust_factor_cerra,
  round(cerra_u10 * dem_eastness + cerra_v10 * dem_northness + 2e-9, 5) AS wind_terrain_align"""
_ROWS = "rows_ AS (SELECT o.station_id, o.date FROM obs o JOIN cerra c USING (station_id, date))"
_WEIGHTED = "tw AS (SELECT r.station_id, r.date, " + ", ".join(f"coalesce(max(CASE WHEN zone = {k} THEN weight END), 1) * coalesce(any_value(sm.zone_{k}), 0.25) AS r{k}" for k in range(4)) + " FROM rows_ r LEFT JOIN w USING (station_id) LEFT JOIN sm USING (station_id) GROUP BY 1, 2), twn AS (SELECT station_id, date, " + ", ".join(f"r{k} / avg(r{k}) OVER () AS zone_weight_{k}" for k in range(4)) + " FROM tw)"


@query("m01_training_table", _sql(*zonal._SIM, zonal._MEMB, _CERRA, _GEO, _ROWS, _WEIGHTED, body=_TRAIN + ", " + ", ".join(f"round(zone_weight_{k}, 5) AS zone_weight_{k}" for k in range(4)) + " FROM obs o JOIN cerra c USING (station_id, date) LEFT JOIN geo g USING (station_id) JOIN twn USING (station_id, date)"))
def training_table(spark, d):
    out = ds.training_table(roles.obs(spark, d), _cerra(spark, d), _geo(spark, d), zonal._similar(spark, d), zones.memberships(roles.stations(spark, d)))
    out = out.withColumn("month_sin", F.col("month_sin") + 2e-9)
    six = ("obs_tmax_cerra", "month_sin", "delta_elev_m", "lapse_correction_c")
    return out.select(
        "station_id", "date", *[r6(F.col(c)).alias(c) for c in six], r6(F.col("gust_factor_cerra") + 2e-9).alias("gust_factor_cerra"), F.round(F.col("wind_terrain_align") + 2e-9, 5).alias("wind_terrain_align"), *[F.round(f"zone_weight_{k}", 5).alias(f"zone_weight_{k}") for k in range(4)]
    )


@query("p20_mapping_source", _sql(roles.OBS, body="SELECT station_id, date, round(greatest(0, obs_wind / 10 * pred_prcp) + 2e-9, 6) AS hurdle, round(pred_prcp + 2e-9, 6) AS best, round(CASE WHEN obs_wind / 10 > 0.5 THEN obs_prcp ELSE 0 END + 2e-9, 6) AS gated FROM obs"))
def mapping_source(spark, d):
    """The amount that mapping starts from, by which columns there are."""
    o = roles.obs(spark, d).withColumns({"precip_occurrence_prob": F.col("obs_wind") / 10, "precip_mean": F.col("pred_prcp"), "precip_best": F.col("pred_prcp"), "precip_p50": F.col("obs_prcp")})
    have = {"hurdle": ["precip_occurrence_prob", "precip_mean"], "best": ["precip_best"], "gated": ["precip_occurrence_prob", "precip_p50"]}
    return o.select("station_id", "date", *[r6(wx.precip_source(c) + 2e-9).alias(n) for n, c in have.items()])


def _predicted(spark, d):
    o = roles.obs(spark, d)
    return o.select(
        "station_id",
        "date",
        F.col("obs_tmean").alias("tmean_p50"),
        F.col("obs_tmin").alias("tmin_p50"),
        F.col("pred_tmax").alias("tmax_p50"),
        (F.col("obs_wind") * 9).alias("rh_p50"),
        F.col("obs_wind").alias("wind_mean"),
        (F.col("obs_wind") * 2).alias("gust_mean"),
        (F.col("obs_wind") / 10).alias("precip_occurrence_prob"),
        F.when(F.col("obs_prcp") > 2, F.col("pred_prcp")).alias("precip_mean"),
        F.when(F.col("obs_prcp") > 5, F.col("obs_prcp")).alias("precip_best_eqm"),
    )


_DAILY = "SELECT station_id, date, round(obs_tmean, 6) AS tmean_c, round(obs_tmin, 6) AS tmin_c, round(pred_tmax, 6) AS tmax_c, round(obs_wind * 9, 6) AS rh_pct, round(obs_wind, 6) AS wind_ms, round(obs_wind * 2, 6) AS gust_ms, round({p} + 2e-9, 6) AS precip_mm FROM obs"


def _rounded(df):
    return df.select("station_id", "date", *[r6(F.col(c)).alias(c) for c in ds.DAILY], r6(F.col("precip_mm") + 2e-9).alias("precip_mm"))


@query("p22_daily_best", _sql(roles.OBS, body=_DAILY.format(p="coalesce(CASE WHEN obs_prcp > 5 THEN obs_prcp END, 0)")))
def daily_best(spark, d):
    return _rounded(ds.daily_best(_predicted(spark, d), ["station_id", "date"]))


@query("p23_daily_without_mapping", _sql(roles.OBS, body=_DAILY.format(p="CASE WHEN obs_prcp > 2 THEN greatest(0, obs_wind / 10 * pred_prcp) END")))
def daily_without_mapping(spark, d):
    return _rounded(ds.daily_best(_predicted(spark, d).drop("precip_best_eqm"), ["station_id", "date"]))


_LONG = "long AS (SELECT station_id, date, 'obs' AS source, obs_tmax AS tmax FROM obs UNION ALL SELECT station_id, date, 'pred', pred_tmax FROM obs UNION ALL SELECT station_id, date, 'base', base_tmax FROM obs)"


@query("u07_source_split", _sql(roles.OBS, _LONG, body="SELECT station_id, date, round(tmax, 6) AS tmax FROM long WHERE source = 'pred'"))
def source_split(spark, d):
    o = roles.obs(spark, d)
    long = None
    for s in ("obs", "pred", "base"):
        x = o.select("station_id", "date", F.lit(s).alias("source"), F.col(f"{s}_tmax").alias("tmax"))
        long = x if long is None else long.unionByName(x)
    return ds.of_source(long, "pred").withColumn("tmax", r6(F.col("tmax")))


@query("f12_size_guards", _sql(roles.OBS, "v AS (SELECT station_id, CASE WHEN month(date) = 2 THEN 'rare' WHEN station_id % 50 = 0 THEN 'local' ELSE 'common' END AS variable FROM obs)", body="SELECT variable, count(DISTINCT station_id)::BIGINT AS n_stations, count(*)::BIGINT AS n_rows FROM v GROUP BY 1 HAVING count(DISTINCT station_id) >= 5 AND count(*) >= 1000"))
def size_guards(spark, d):
    o = roles.obs(spark, d)
    v = F.when(F.month("date") == 2, "rare").when(F.col("station_id") % 50 == 0, "local").otherwise("common")
    return ds.pooled_donors(o.select("station_id", v.alias("variable")))

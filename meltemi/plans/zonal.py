"""Zones, similarity of stations, weights and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions.numeric import r6
from meltemi.operators import zones
from meltemi.operators.align import mean_one
from meltemi.operators.indices import monthly_climatology
from meltemi.operators.learn import zone_blend
from meltemi.plans import roles
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query
_K = range(len(zones.ZONES))
_CLIM = [f"t_m{i:02d}" for i in range(1, 13)]


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def _member(name: str, source: str) -> str:
    z = []
    for k, (_, c, s) in enumerate(zones.ZONES):
        z.append(" * ".join(f"exp(-(x{i} - {c[i]}::DOUBLE) * (x{i} - {c[i]}::DOUBLE) / (2 * {s[i]}::DOUBLE * {s[i]}::DOUBLE))" for i in range(3)) + f" AS z{k}")
    total = " + ".join(f"z{k}" for k in _K)
    return (
        f"{name}_x AS (SELECT *, 1 - least(greatest(ln(1 + greatest(coast_km, 0)), 0), 1) AS x0, least(greatest(elevation_m, 0), 110) / 110 AS x1, coalesce(northness, 0) AS x2 FROM {source}), "
        f"{name}_z AS (SELECT *, {', '.join(z)} FROM {name}_x), "
        f"{name} AS (SELECT *, " + ", ".join(f"z{k} / (CASE WHEN {total} = 0 THEN 1 ELSE {total} END) AS zone_{k}" for k in _K) + f" FROM {name}_z)"
    )


_ZR = ", ".join(f"round(zone_{k}, 6) AS zone_{k}" for k in _K)


@query("z01_memberships", _sql(roles.TARGETS, _member("m", "targets"), body=f"SELECT id, {_ZR} FROM m"))
def memberships(spark, d):
    return zones.memberships(roles.targets(spark, d)).select("id", *[r6(F.col(f"zone_{k}")).alias(f"zone_{k}") for k in _K])


_C = f"clim AS (SELECT station_id, {', '.join(f'avg(CASE WHEN month(date) = {i} THEN obs_tmean END) AS t_m{i:02d}' for i in range(1, 13))} FROM obs GROUP BY 1)"
_ST = f"st AS (SELECT s.*, {', '.join(f'coalesce({c}, 17) AS {c}' for c in _CLIM)} FROM stations s LEFT JOIN clim USING (station_id))"
_TG = f"tg AS (SELECT *, {', '.join(f'elevation_m / 10 + {i} AS {c}' for i, c in enumerate(_CLIM))} FROM targets)"


def _stations(spark, d):
    c = monthly_climatology(roles.obs(spark, d), "station_id", "date", "obs_tmean", "t")
    return roles.stations(spark, d).join(c, "station_id", "left").withColumns({m: F.coalesce(F.col(m), F.lit(17.0)) for m in _CLIM})


def _targets(spark, d):
    return roles.targets(spark, d).withColumns({c: F.col("elevation_m") / 10 + i for i, c in enumerate(_CLIM)})


def _weights(keys: str, name: str = "w") -> str:
    """CTEs of the combined weights from rows (keys, se, sc, de, dc, dm, is_island)."""
    g = lambda x, s: f"CASE WHEN {s} = 0 THEN 1 ELSE exp(-({x} * {x}) / (2 * {s} * {s})) END"
    iq = lambda c, n: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {n}"
    return f"sig AS (SELECT {keys}, {iq('se', 'ie')}, {iq('sc', 'ic')}, {iq('dm', 'im')} FROM d GROUP BY {keys}), raw AS (SELECT d.*, {g('de', 'ie')} * {g('dc', 'ic')} * {g('dm', 'im')} * CASE WHEN is_island THEN 1.5e0 ELSE 1 END AS r FROM d JOIN sig USING ({keys})), {name} AS (SELECT *, CASE WHEN avg(r) OVER (PARTITION BY {keys}) = 0 THEN 1 ELSE r / avg(r) OVER (PARTITION BY {keys}) END AS weight FROM raw)"


_LC = "ln(1 + greatest(coast_km, 0))"
_CEN = "cen AS (" + " UNION ALL ".join(f"SELECT {k} AS zone, sum(zone_{k} * elevation_m) / sum(zone_{k}) AS ce, sum(zone_{k} * {_LC}) / sum(zone_{k}) AS cc, " + ", ".join(f"sum(zone_{k} * {c}) / sum(zone_{k}) AS c_{c}" for c in _CLIM) + " FROM m" for k in _K) + ")"
_DM = "sqrt(" + " + ".join(f"({c} - c_{c}) * ({c} - c_{c})" for c in _CLIM) + ")"
_SIM = [roles.OBS, roles.STATIONS, roles.TARGETS, _C, _ST, _TG, _member("m", "tg"), _CEN, f"d AS (SELECT station_id, zone, elevation_m AS se, {_LC} AS sc, elevation_m - ce AS de, {_LC} - cc AS dc, {_DM} AS dm, is_island FROM st, cen)", _weights("zone")]


def _similar(spark, d):
    return zones.zone_similarity(_stations(spark, d), zones.memberships(_targets(spark, d)), _CLIM)


@query("z02_similarity", _sql(*_SIM, body="SELECT station_id, zone, round(weight, 6) AS weight FROM w"))
def zone_similarity(spark, d):
    return _similar(spark, d).withColumn("weight", r6(F.col("weight")))


@query("z03_climate_distance", _sql(roles.OBS, roles.STATIONS, roles.TARGETS, _C, _ST, _TG, "cen AS (SELECT " + ", ".join(f"avg({c}) AS c_{c}" for c in _CLIM) + " FROM tg)", body=f"SELECT station_id, round({_DM}, 6) AS distance FROM st, cen"))
def climate_distance(spark, d):
    c = _targets(spark, d).agg(*[F.avg(m).alias(f"c_{m}") for m in _CLIM])
    dist = zones.climate_distance([F.col(m) for m in _CLIM], [F.col(f"c_{m}") for m in _CLIM])
    return _stations(spark, d).join(F.broadcast(c)).select("station_id", r6(dist).alias("distance"))


@query("z04_legacy_similarity", _sql(roles.OBS, roles.STATIONS, roles.TARGETS, _C, _ST, _TG, "cen AS (SELECT 0 AS zone, avg(elevation_m) AS ce, avg(coast_km) AS cc, " + ", ".join(f"avg({c}) AS c_{c}" for c in _CLIM) + " FROM tg)", f"d AS (SELECT station_id, zone, elevation_m AS se, coast_km AS sc, elevation_m - ce AS de, coast_km - cc AS dc, {_DM} AS dm, is_island FROM st, cen)", _weights("zone"), body="SELECT station_id, round(weight, 6) AS weight FROM w"))
def legacy(spark, d):
    return zones.similarity(_stations(spark, d), _targets(spark, d), _CLIM).withColumn("weight", r6(F.col("weight")))


_MEMB = _member("sm", "stations")
_TW = "tw AS (SELECT o.station_id, o.date, " + ", ".join(f"coalesce(max(CASE WHEN zone = {k} THEN weight END), 1) * coalesce(any_value(sm.zone_{k}), 0.25) AS r{k}" for k in _K) + " FROM obs o LEFT JOIN w USING (station_id) LEFT JOIN sm USING (station_id) GROUP BY 1, 2)"


@query("z05_training_weights", _sql(*_SIM, _MEMB, _TW, body="SELECT station_id, date, " + ", ".join(f"round(r{k} / avg(r{k}) OVER (), 5) AS zone_weight_{k}" for k in _K) + " FROM tw"))
def training(spark, d):
    rows = roles.obs(spark, d).select("station_id", "date")
    out = zones.training_weights(rows, _similar(spark, d), zones.memberships(roles.stations(spark, d)))
    return out.select("station_id", "date", *[F.round(f"zone_weight_{k}", 5).alias(f"zone_weight_{k}") for k in _K])


@query("j10_weight_report", _sql(roles.STATIONS, _MEMB, body=f"SELECT m.station_id, round(s.lat, 6) AS lat, s.is_island, {_ZR}, 'zone_' || CAST(list_position([zone_0, zone_1, zone_2, zone_3], greatest(zone_0, zone_1, zone_2, zone_3)) - 1 AS VARCHAR) AS dominant_zone FROM (SELECT station_id, lat, is_island FROM stations WHERE station_id % 3 > 0) s RIGHT JOIN sm m USING (station_id)"))
def weight_report(spark, d):
    s = roles.stations(spark, d)
    meta = s.where("station_id % 3 > 0").select("station_id", r6(F.col("lat")).alias("lat"), "is_island")
    w = zones.memberships(s).select("station_id", *[f"zone_{k}" for k in _K])
    out = meta.join(w, "station_id", "right").withColumn("dominant_zone", zones.dominant([f"zone_{k}" for k in _K]))
    return out.select("station_id", "lat", "is_island", *[r6(F.col(f"zone_{k}")).alias(f"zone_{k}") for k in _K], "dominant_zone").orderBy(F.col("zone_0").desc())


@query("j23_zone_blend", _sql(roles.OBS, roles.STATIONS, _MEMB, body="SELECT o.station_id, o.date, round((coalesce(zone_0, 0.25) * obs_tmax + coalesce(zone_1, 0.25) * pred_tmax + coalesce(zone_2, 0.25) * base_tmax + coalesce(zone_3, 0.25) * obs_tmean) / (coalesce(zone_0, 0.25) + coalesce(zone_1, 0.25) + coalesce(zone_2, 0.25) + coalesce(zone_3, 0.25)), 6) AS blend FROM obs o LEFT JOIN (SELECT * FROM sm WHERE station_id % 5 > 0) z USING (station_id)"))
def blend(spark, d):
    w = zones.memberships(roles.stations(spark, d).where("station_id % 5 > 0")).select("station_id", *[f"zone_{k}" for k in _K])
    o = roles.obs(spark, d).join(w, "station_id", "left")
    out = zone_blend(o, ["obs_tmax", "pred_tmax", "base_tmax", "obs_tmean"], [f"zone_{k}" for k in _K], "blend")
    return out.select("station_id", "date", r6(F.col("blend")).alias("blend"))


@query("w01_mean_one", _sql(roles.STATIONS, body="SELECT station_id, round(elevation_m / avg(elevation_m) OVER (), 6) AS w FROM stations"))
def normalised(spark, d):
    s = roles.stations(spark, d).select("station_id", F.col("elevation_m").alias("w"))
    return mean_one(s, "w").withColumn("w", r6(F.col("w")))

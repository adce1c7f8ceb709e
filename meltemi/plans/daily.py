"""Ingest filters, alignment joins and daily aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions.calendar import init_day
from meltemi.functions.numeric import r6
from meltemi.operators import align
from meltemi.operators.indices import circular_mean, daily, monthly_climatology
from meltemi.functions.weather import wind_u, wind_v
from meltemi.plans import roles
from meltemi.plans.registry import Registry
from meltemi.sources import stations as st

QUERIES = Registry()
query = QUERIES.query


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


@query("f01_bbox", _sql(roles.STATIONS, body="SELECT station_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM stations WHERE lat BETWEEN 34 AND 40 AND lon BETWEEN 12 AND 25"))
def bbox(spark, d):
    return st.within(roles.stations(spark, d), (34, 40), (12, 25)).select("station_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("f02_has_rain", _sql(roles.OBS, body="SELECT station_id, date, round(obs_prcp, 6) AS obs_prcp FROM obs WHERE station_id IN (SELECT station_id FROM obs GROUP BY 1 HAVING max(obs_prcp) > 70)"))
def has_rain(spark, d):
    return st.with_rain(roles.obs(spark, d), "obs_prcp", 70.0).select("station_id", "date", r6(F.col("obs_prcp")).alias("obs_prcp"))


@query("f14_month_coverage", _sql(roles.OBS, body="SELECT station_id, (12 - count(DISTINCT month(date)))::BIGINT AS n_missing, count(DISTINCT date)::BIGINT AS n_days FROM obs WHERE month(date) <= station_id % 12 + 1 GROUP BY 1"))
def month_coverage(spark, d):
    o = roles.obs(spark, d).where(F.month("date") <= F.col("station_id") % 12 + 1)
    return align.missing_months(o, "station_id", "date").join(o.groupBy("station_id").agg(F.count_distinct("date").alias("n_days")), "station_id")


_BY = "SELECT id, CAST(ts AS DATE) AS date, {agg} FROM sub WHERE event_type = '{t}' GROUP BY 1, 2"


@query("j03_full_outer", _sql(roles.SUB, f"a AS ({_BY.format(agg='round(avg(value), 6) AS click', t='click')})", f"b AS ({_BY.format(agg='round(max(value), 6) AS view', t='view')})", body="SELECT id, date, click, view FROM a FULL JOIN b USING (id, date)"))
def full_outer(spark, d):
    s = roles.sub(spark, d).withColumn("date", F.to_date("ts"))
    a = s.where("event_type = 'click'").groupBy("id", "date").agg(r6(F.avg("value")).alias("click"))
    b = s.where("event_type = 'view'").groupBy("id", "date").agg(r6(F.max("value")).alias("view"))
    return a.join(b, ["id", "date"], "full")


_TYPES = ("click", "view", "error")


@query("j04_align_columns", _sql(roles.SUB, body=f"SELECT id, CAST(ts AS DATE) AS date, {', '.join(f'round(max(CASE WHEN event_type = {t!r} THEN value END), 6) AS {t}' for t in _TYPES)} FROM sub WHERE event_type IN {_TYPES} GROUP BY 1, 2"))
def align_columns(spark, d):
    s = roles.sub(spark, d).withColumn("date", F.to_date("ts"))
    frames = {t: s.where(F.col("event_type") == t).groupBy("id", "date").agg(F.max("value").alias("value")) for t in _TYPES}
    out = align.aligned(frames, ["id", "date"], "value")
    return out.select("id", "date", *[r6(F.col(t)).alias(t) for t in _TYPES])


@query("u05_unpivot", _sql(roles.OBS, body="SELECT station_id, date, variable, round(value, 6) AS value FROM (SELECT station_id, date, obs_tmin, obs_tmean, obs_tmax FROM obs) UNPIVOT (value FOR variable IN (obs_tmin, obs_tmean, obs_tmax))"))
def unpivot(spark, d):
    out = roles.obs(spark, d).unpivot(["station_id", "date"], ["obs_tmin", "obs_tmean", "obs_tmax"], "variable", "value")
    return out.withColumn("value", r6(F.col("value")))


@query("u01_union_years", _sql(roles.OBS, body="SELECT year(date)::INT AS year, count(*)::BIGINT AS n, count(DISTINCT station_id)::BIGINT AS stations FROM (SELECT * FROM obs WHERE year(date) = 1996 UNION ALL SELECT * FROM obs WHERE year(date) = 1998) GROUP BY 1"))
def union_years(spark, d):
    o = roles.obs(spark, d).withColumn("year", F.year("date"))
    both = o.where("year = 1996").unionByName(o.where("year = 1998"))
    return both.groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("stations"))


@query("u03_except_intersect", "SELECT k, kind FROM (SELECT s_suppkey AS k, 'station only' AS kind FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT s_suppkey, 'both' FROM (SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))")
def except_intersect(spark, d):
    s = roles.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    c = roles.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return s.subtract(c).withColumn("kind", F.lit("station only")).union(s.intersect(c).withColumn("kind", F.lit("both")))


@query("j20_companion_files", _sql(roles.OBS, body="SELECT a.station_id, a.date, round(a.obs_tmean, 6) AS tas, round(b.obs_prcp, 6) AS pr FROM obs a LEFT JOIN (SELECT station_id, date, obs_prcp FROM obs WHERE month(date) % 2 = 0) b USING (station_id, date)"))
def companion(spark, d):
    o = roles.obs(spark, d)
    b = o.where(F.month("date") % 2 == 0).select("station_id", "date", r6(F.col("obs_prcp")).alias("pr"))
    return o.select("station_id", "date", r6(F.col("obs_tmean")).alias("tas")).join(b, ["station_id", "date"], "left")


@query("w03_keep_first", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return align.first_by(roles.table(spark, d, "lineitem"), ["l_suppkey"], order).select("l_suppkey", *order[1:])


@query("j08_feature_matrix", _sql(roles.STATIONS, "s AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, l_quantity::DOUBLE AS q, l_orderkey FROM lineitem)", "a AS (SELECT *, row_number() OVER (PARTITION BY id, date ORDER BY q, l_orderkey) AS r FROM s)", "g AS (SELECT nationkey AS id, elevation_m, lat, row_number() OVER (PARTITION BY nationkey ORDER BY elevation_m, lat) AS r FROM stations)", body="SELECT a.id, a.date, a.q, a.l_orderkey, g.elevation_m, g.lat FROM a LEFT JOIN g ON g.id = a.id AND g.r = 1 WHERE a.r = 1"))
def feature_matrix(spark, d):
    """One row a supplier and day with the features of the place of its number; most numbers have none."""
    s = roles.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("double").alias("q"), "l_orderkey")
    g = roles.stations(spark, d).select(F.col("nationkey").cast("long").alias("id"), "elevation_m", "lat")
    return align.feature_matrix(s, g).select("id", "date", "q", "l_orderkey", "elevation_m", "lat")


@query("a01_daily_stats", _sql(roles.SUB, body="SELECT id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value_avg, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM sub GROUP BY 1, 2"))
def daily_stats(spark, d):
    out = daily(roles.sub(spark, d), "id", "ts", "value")
    return out.select("id", "date", *[r6(F.col(c)).alias(c) for c in ("value_avg", "value_min", "value_max")])


_CIRC = "degrees(atan2(avg(sin(radians(direction))), avg(cos(radians(direction)))))"


@query("a02_circular_mean", _sql(roles.SUB, body=f"SELECT id, CAST(ts AS DATE) AS date, round({_CIRC}, 4) AS mean_dir FROM sub GROUP BY 1, 2"))
def circular(spark, d):
    return roles.sub(spark, d).groupBy("id", F.to_date("ts").alias("date")).agg(F.round(circular_mean(F.col("direction")), 4).alias("mean_dir"))


@query("p07_wind_components", _sql(roles.SUB, f"w AS (SELECT id, CAST(ts AS DATE) AS date, avg(value) AS wind, {_CIRC} AS dir FROM sub GROUP BY 1, 2)", body="SELECT id, date, round(-wind * sin(radians(dir)), 4) AS u10, round(-wind * cos(radians(dir)), 4) AS v10 FROM w"))
def components(spark, d):
    w = roles.sub(spark, d).groupBy("id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("wind"), circular_mean(F.col("direction")).alias("dir"))
    return w.select("id", "date", F.round(wind_u(F.col("wind"), F.col("dir")), 4).alias("u10"), F.round(wind_v(F.col("wind"), F.col("dir")), 4).alias("v10"))


_INIT = "CASE WHEN hour(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END"


@query("a03_init_day_max", _sql(roles.SUB, body=f"SELECT id, CAST({_INIT} AS DATE) AS date, round(max(value), 6) AS value_max FROM sub GROUP BY 1, 2"))
def init_day_max(spark, d):
    out = daily(roles.sub(spark, d), "id", "ts", "value", ("max",), init_day(F.col("ts")))
    return out.withColumn("value_max", r6(F.col("value_max")))


@query("a04_init_day_mean", _sql(roles.SUB, body=f"SELECT id, CAST({_INIT} AS DATE) AS date, round(avg(value), 6) AS value_avg FROM sub GROUP BY 1, 2"))
def init_day_mean(spark, d):
    out = daily(roles.sub(spark, d), "id", "ts", "value", ("avg",), init_day(F.col("ts")))
    return out.withColumn("value_avg", r6(F.col("value_avg")))


@query("a05_midnight_total", _sql(roles.SUB, body=f"SELECT id, CAST({_INIT} AS DATE) AS date, round(sum(value), 6) AS total FROM sub WHERE hour(ts) = 0 GROUP BY 1, 2"))
def midnight_total(spark, d):
    s = roles.sub(spark, d).where(F.hour("ts") == 0)
    return s.groupBy("id", init_day(F.col("ts")).alias("date")).agg(r6(F.sum("value")).alias("total"))


@query("a06_monthly_clim", _sql(roles.OBS, body=f"SELECT station_id, {', '.join(f'round(avg(CASE WHEN month(date) = {i} THEN obs_tmean END), 6) AS t_m{i:02d}' for i in range(1, 13))} FROM obs GROUP BY 1"))
def monthly_clim(spark, d):
    out = monthly_climatology(roles.obs(spark, d), "station_id", "date", "obs_tmean", "t")
    return out.select("station_id", *[r6(F.col(f"t_m{i:02d}")).alias(f"t_m{i:02d}") for i in range(1, 13)])


@query("a32_distinct_counts", _sql(roles.OBS, body="SELECT year(date)::INT AS year, count(DISTINCT station_id)::BIGINT AS stations, count(DISTINCT date)::BIGINT AS days FROM obs GROUP BY 1"))
def distinct_counts(spark, d):
    return roles.obs(spark, d).groupBy(F.year("date").alias("year")).agg(F.count_distinct("station_id").alias("stations"), F.count_distinct("date").alias("days"))


@query("f18_group_membership", _sql(roles.STATIONS, body="SELECT s.station_id, r.r_name AS grp, s.station_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS missing FROM stations s JOIN nation n ON n.n_nationkey = s.nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"))
def group_membership(spark, d):
    groups = roles.stations(spark, d).join(roles.table(spark, d, "nation"), F.col("nationkey") == F.col("n_nationkey")).join(roles.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("station_id", F.col("r_name").alias("grp"))
    have = roles.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("station_id"))
    return align.present_and_missing(groups, have, "station_id")


@query("s19_resume", _sql(roles.STATIONS, body="SELECT station_id FROM stations WHERE station_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.1)"))
def resume(spark, d):
    from meltemi.sources.files import unfinished

    done = roles.table(spark, d, "lineitem").where("l_quantity = 50 AND l_discount >= 0.1D").select(F.col("l_suppkey").alias("station_id"))
    return unfinished(roles.stations(spark, d).select("station_id"), done, "station_id")

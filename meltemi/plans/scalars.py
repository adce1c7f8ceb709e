"""Unit conversions, derived variables, calendar and string expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltemi.functions import calendar as cal
from meltemi.functions import weather as wx
from meltemi.functions.numeric import clip, r6
from meltemi.plans import roles
from meltemi.plans.registry import Registry
from meltemi.sources import files

QUERIES = Registry()
query = QUERIES.query


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


@query("s11_row_ids", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS id, p_retailprice AS elevation_m FROM part")
def row_ids(spark, d):
    return files.numbered(roles.table(spark, d, "part"), "p_partkey").select("p_partkey", "id", F.col("p_retailprice").alias("elevation_m"))


@query("s26_href_links", """SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)""")
def href_links(spark, d):
    return files.links(roles.table(spark, d, "pages"), "html")


_NAMES = ["tas_EUR-11_A_historical_r1_day_19810101-19851231.nc", "tas_EUR-11_A_historical_r1_day_19860101-19901231.nc", "tas_EUR-11_A_rcp85_r1_day_20060101-20101231.nc", "orog_EUR-11_A_fx.nc", "tas_EUR-11_A_historical_r1_day_20010101-20051230.nc"]


@query(
    "s08_range_overlap",
    "SELECT name, a AS first_year, b AS last_year FROM (SELECT name, try_cast(regexp_extract(name, '_day_([0-9]{4})[0-9]{4}-([0-9]{4})[0-9]{4}[.]nc$', 1) AS INT) AS a, try_cast(regexp_extract(name, '_day_([0-9]{4})[0-9]{4}-([0-9]{4})[0-9]{4}[.]nc$', 2) AS INT) AS b FROM (VALUES "
    + ", ".join(f"('{n}')" for n in _NAMES)
    + ") v(name)) WHERE a <= 2005 AND b >= 1985",
)
def range_overlap(spark, d):
    return files.overlapping(spark.createDataFrame([(n,) for n in _NAMES], "name string"), "name", 1985, 2005)


@query("p01_unit_conversions", _sql(roles.SUB, body="SELECT id, ts, round((value - 32) * 5 / 9, 6) AS temp_c, round(value * 25.4, 6) AS rain_mm, round(value * 0.514444, 6) AS wind_ms, round(value - 273.15, 6) AS kelvin_c, round(value * 86400, 4) AS flux_mm, round(value * 1000, 6) AS metres_mm FROM sub"))
def unit_conversions(spark, d):
    v = F.col("value")
    return roles.sub(spark, d).select("id", "ts", r6(wx.f_to_c(v)).alias("temp_c"), r6(wx.inches_to_mm(v)).alias("rain_mm"), r6(wx.knots_to_ms(v)).alias("wind_ms"), r6(wx.k_to_c(v)).alias("kelvin_c"), F.round(wx.flux_to_mm_day(v), 4).alias("flux_mm"), r6(wx.m_to_mm(v)).alias("metres_mm"))


_RAW = "CASE WHEN value > 300 THEN '9999.9' WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 3 = 0 THEN concat(CAST(event_id AS VARCHAR), '.5*') ELSE concat(CAST(event_id % 9999 AS VARCHAR), ' ') END"


@query("p03_sentinel_mask", f"SELECT event_id, CASE WHEN v < 9999.9 THEN v END AS masked, trim(raw) AS raw FROM (SELECT event_id, {_RAW} AS raw, try_cast(rtrim({_RAW}, '* ') AS DOUBLE) AS v FROM events)")
def sentinel_mask(spark, d):
    e = roles.table(spark, d, "events").withColumn("raw", F.expr(_RAW.replace("VARCHAR", "STRING")))
    return e.select("event_id", wx.masked(F.col("raw"), 9999.9).alias("masked"), F.trim("raw").alias("raw"))


@query("p04_rh_magnus", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, 100 * exp(17.625e0 * td / (243.04e0 + td)) / exp(17.625e0 * t / (243.04e0 + t)))), 6) AS rh FROM (SELECT *, l_quantity - 10 AS t, l_quantity - 10 - l_discount * 100 AS td FROM lineitem)")
def rh_magnus(spark, d):
    t = F.col("l_quantity") - 10
    return roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(wx.rh_from_dewpoint(t, t - F.col("l_discount") * 100)).alias("rh"))


@query("p05_rh_from_q", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, 100 * (q * p / (0.622e0 + 0.378e0 * q)) / (611.2e0 * exp(17.67e0 * (t - 273.15e0) / (t - 273.15e0 + 243.5e0))))), 6) AS rh FROM (SELECT *, l_quantity + 250 AS t, l_tax / 10 AS q, coalesce(CASE WHEN l_linenumber > 2 THEN l_extendedprice + 50000 END, 101325) AS p FROM lineitem)")
def rh_from_q(spark, d):
    li = roles.table(spark, d, "lineitem")
    p = F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice") + 50000)
    return li.select("l_orderkey", "l_linenumber", r6(wx.rh_from_specific(F.col("l_tax") / 10, F.col("l_quantity") + 250, p)).alias("rh"))


_FEATURES = """
SELECT o.station_id, o.date, round(sin(2 * pi() * month(o.date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(o.date) / 12), 6) AS month_cos,
  round(s.elevation_m - 40, 6) AS delta_elev_m, round((s.elevation_m - 40) * ([-4.5e0,-4.8e0,-5.2e0,-5.5e0,-5.8e0,-6.2e0,-6.5e0,-6.5e0,-6.0e0,-5.5e0,-5.0e0,-4.7e0])[month(o.date)] / 1000, 6) AS lapse_correction_c,
  round(CASE WHEN obs_wind = 0 THEN 1 ELSE least(10, greatest(1, obs_tmax / obs_wind)) END, 6) AS gust_factor,
  round(-obs_wind * sin(radians(obs_tmax * 7)) * s.northness + -obs_wind * cos(radians(obs_tmax * 7)) * 0.5e0, 6) AS wind_terrain_align
FROM obs o LEFT JOIN stations s USING (station_id)"""


@query("p08_feature_row", _sql(roles.OBS, roles.STATIONS, body=_FEATURES))
def feature_row(spark, d):
    o = roles.obs(spark, d).join(roles.stations(spark, d), "station_id", "left")
    sin, cos = wx.month_harmonics(F.col("date"))
    delta = F.col("elevation_m") - 40
    deg = F.col("obs_tmax") * 7
    align = wx.wind_u(F.col("obs_wind"), deg) * F.col("northness") + wx.wind_v(F.col("obs_wind"), deg) * 0.5
    return o.select("station_id", "date", r6(sin).alias("month_sin"), r6(cos).alias("month_cos"), r6(delta).alias("delta_elev_m"), r6(wx.lapse_correction(delta, F.col("date"))).alias("lapse_correction_c"), r6(wx.gust_factor(F.col("obs_tmax"), F.col("obs_wind"))).alias("gust_factor"), r6(align).alias("wind_terrain_align"))


@query("p16_p17_ordering", _sql(roles.OBS, body="""
SELECT station_id, date, round(least(obs_tmin, base_tmean), 6) AS tmin, round(greatest(pred_tmax, base_tmean), 6) AS tmax, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90,
  round(greatest(0, least(100, obs_tmin * 3)), 6) AS rh FROM (SELECT *, list_sort([obs_tmax, pred_tmax, base_tmax]) AS q FROM obs)"""))
def ordering(spark, d):
    o = roles.obs(spark, d)
    lo, hi = wx.ordered_temperatures(F.col("obs_tmin"), F.col("base_tmean"), F.col("pred_tmax"))
    q = wx.ordered_quantiles(*map(F.col, ("obs_tmax", "pred_tmax", "base_tmax")))
    return o.select("station_id", "date", r6(lo).alias("tmin"), r6(hi).alias("tmax"), *[r6(c).alias(n) for c, n in zip(q, ("p10", "p50", "p90"))], r6(wx.limited("rh", F.col("obs_tmin") * 3)).alias("rh"))


@query("p19_point_estimate", _sql(roles.OBS, body="""
SELECT station_id, date, round(CASE WHEN obs_wind / 10 > 0.5 THEN obs_prcp ELSE 0 END + 2e-9, 6) AS gated, round(greatest(0, least(obs_wind / 10, 1) * pred_prcp) + 2e-9, 6) AS hurdle, round(coalesce(CASE WHEN obs_prcp > 5 THEN obs_prcp END, 0) + 2e-9, 6) AS filled FROM obs"""))
def point_estimate(spark, d):
    o = roles.obs(spark, d).select("station_id", "date", "obs_prcp", (F.col("obs_wind") / 10).alias("precip_occurrence_prob"), F.col("obs_prcp").alias("precip_p50"), F.col("pred_prcp").alias("precip_mean"))
    gated = wx.precip_estimate(o.columns)
    o = o.withColumn("precip_occurrence_capped", clip(F.col("precip_occurrence_prob"), None, 1.0))
    hurdle = wx.hurdle_amount(F.col("precip_occurrence_capped"), F.col("precip_mean"))
    return o.select("station_id", "date", r6(gated + 2e-9).alias("gated"), r6(hurdle + 2e-9).alias("hurdle"), r6(F.coalesce(F.when(F.col("obs_prcp") > 5, F.col("obs_prcp")), F.lit(0.0)) + 2e-9).alias("filled"))


@query("p24_calendar_doy", "SELECT l_orderkey, l_linenumber, year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, least(dayofyear(l_shipdate), 365)::INT AS doy, ((month(l_shipdate) - 1) * 30 + least(day(l_shipdate), 30))::INT AS doy360, least(abs(dayofyear(l_shipdate) - 10), 366 - abs(dayofyear(l_shipdate) - 10))::INT AS gap FROM lineitem")
def calendar_doy(spark, d):
    t = F.col("l_shipdate")
    return roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.year(t).alias("y"), F.month(t).alias("m"), cal.doy(t, 365).alias("doy"), cal.doy360(F.month(t), F.least(F.day(t), F.lit(30))).alias("doy360"), cal.circular_distance(F.dayofyear(t), 10, 366).alias("gap"))


_DOY360 = "((month(l_shipdate) - 1) * 30 + least(day(l_shipdate), 30))"


@query("p25_map_360_to_365", f"SELECT l_orderkey, l_linenumber, {_DOY360}::INT AS doy360, greatest(1, least(365, round(({_DOY360} - 0.5e0) / 360 * 365 + 0.5e0)))::INT AS doy365 FROM lineitem")
def map_360(spark, d):
    """Days of a calendar of 360 days as days of the year."""
    t = F.col("l_shipdate")
    day = cal.doy360(F.month(t), F.least(F.day(t), F.lit(30)))
    return roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.cast("int").alias("doy360"), cal.map_360_to_365(day).alias("doy365"))


_RISK = "CASE WHEN v / 50 - 18 - 0.8e0 < 0 THEN -1 WHEN v / 50 - 18 - 0.8e0 <= 5 THEN 0 WHEN v / 50 - 18 - 0.8e0 <= 10 THEN 1 ELSE 2 END"


@query("p28_risk_class", _sql(roles.GRID, body=f"SELECT cell_id, {_RISK} AS risk FROM grid"))
def risk(spark, d):
    return roles.grid(spark, d).select("cell_id", wx.risk_class(F.col("v") / 50 - 18).alias("risk"))


@query("a30_risk_counts", _sql(roles.GRID, body=f"SELECT {_RISK} AS risk, count(*)::BIGINT AS n FROM grid GROUP BY 1"))
def risk_counts(spark, d):
    return roles.grid(spark, d).groupBy(wx.risk_class(F.col("v") / 50 - 18).alias("risk")).agg(F.count("*").alias("n"))


@query("p30_strings", "SELECT p_partkey, trim(concat(' ', p_name, ' ')) AS name, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS brand, regexp_replace(p_type, '_?(NOM|ECO)', '') AS kind, try_cast(regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS INT) AS brand_no FROM part")
def strings(spark, d):
    p = roles.table(spark, d, "part")
    b = F.regexp_extract("p_brand", "Brand#([0-9]+)", 1)
    return p.select("p_partkey", F.trim(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"), b.alias("brand"), F.regexp_replace("p_type", "^(.*?)_?(NOM|ECO)", "$1").alias("kind"), b.try_cast("int").alias("brand_no"))

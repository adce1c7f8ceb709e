"""Tables of the engine's roles, made from the general-purpose tables; each as a DataFrame and as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_OBS = {
    "obs_tmax": "avg(l_quantity)",
    "obs_tmean": "avg(l_quantity) - 8",
    "obs_tmin": "avg(l_quantity) - 15",
    "obs_prcp": "avg(greatest(l_extendedprice / 1000 - 30, 0))",
    "obs_wind": "avg(l_discount * 100)",
    "pred_tmax": "avg(l_quantity * (0.95 + l_discount))",
    "pred_tmean": "avg(l_quantity * (0.95 + l_discount)) - 8",
    "pred_tmin": "avg(l_quantity * (0.95 + l_discount)) - 15",
    "pred_prcp": "avg(greatest(l_extendedprice / 1000 - 30, 0) * (1 + l_tax - l_discount))",
    "base_tmax": "avg(l_quantity + l_tax * 20 - 1)",
    "base_tmean": "avg(l_quantity + l_tax * 20 - 1) - 8",
    "base_tmin": "avg(l_quantity + l_tax * 20 - 1) - 15",
    "base_prcp": "avg(greatest(l_extendedprice / 1000 - 30, 0) * 0.9)",
}
_DOUBLE = "greatest(l_extendedprice / 1000 - 30, 0)"


def _expr(sql: str) -> str:
    """Spark reads 0.95 as a decimal; as a double the arithmetic is that of the SQL twin."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", sql)


def _exact(sql: str) -> str:
    """avg(...) of an expression by whole units of 1e-7, whose sum is the same in any order of the rows.

    The values have at most seven decimals. Sums of doubles differ in their last bits by order, and means that equal a
    threshold or the middle of two roundings would fall to either side by chance.
    """
    import re

    return re.sub(r"^avg\((.*)\)( - \d+)?$", r"(CAST(sum(CAST(round((\1) * 10000000) AS BIGINT)) AS DOUBLE) / 1e7 / count(\1))\2", sql)


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Station days: observations, predictions and a baseline."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"))
    return rows.agg(*[F.expr(_expr(_exact(e))).alias(c) for c, e in _OBS.items()])


OBS = "obs AS (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, " + ", ".join(f"{_exact(e)} AS {c}" for c, e in _OBS.items()) + " FROM lineitem GROUP BY 1, 2)"


def donor(spark: SparkSession, d: str, odd: int) -> DataFrame:
    """Pairs of observed and modelled precipitation: rows of even (donors) or odd (targets) suppliers."""
    li = table(spark, d, "lineitem").where(F.col("l_suppkey") % 2 == odd)
    return li.select(F.col("l_suppkey").alias("id"), F.dayofyear("l_shipdate").alias("doy"), F.greatest(F.col("l_quantity") - 20, F.lit(0.0)).alias("obs"), F.greatest(F.col("l_extendedprice") / 1000 - 30, F.lit(0.0)).alias("mdl"))


def donor_sql(odd: int, name: str) -> str:
    return f"{name} AS (SELECT l_suppkey AS id, dayofyear(l_shipdate)::INT AS doy, greatest(l_quantity - 20, 0) AS obs, {_DOUBLE} AS mdl FROM lineitem WHERE l_suppkey % 2 = {odd})"


def ens(spark: SparkSession, d: str) -> DataFrame:
    """Daily series of an ensemble: model, scenario, point, date, tmean, precip."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("scenario"), (F.col("l_suppkey") % 5).alias("point"), F.to_date("l_shipdate").alias("date"))
    return rows.agg(F.avg("l_quantity").alias("tmean"), F.avg(F.greatest(F.col("l_extendedprice") / 1000 - 30, F.lit(0.0))).alias("precip")).withColumn("year", F.year("date"))


ENS = f"ens AS (SELECT l_returnflag AS model, l_linestatus AS scenario, l_suppkey % 5 AS point, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS tmean, avg({_DOUBLE}) AS precip, year(CAST(l_shipdate AS DATE))::INT AS year FROM lineitem GROUP BY ALL)"
ENS = f"e0 AS (SELECT l_returnflag AS model, l_linestatus AS scenario, l_suppkey % 5 AS point, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS tmean, avg({_DOUBLE}) AS precip FROM lineitem GROUP BY 1, 2, 3, 4), ens AS (SELECT *, year(date)::INT AS year FROM e0)"


def sub(spark: SparkSession, d: str) -> DataFrame:
    """Sub-daily values by location."""
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_type", "value", (F.col("value") % 360).alias("direction"))


SUB = "sub AS (SELECT user_id AS id, ts, event_type, value, value % 360 AS direction FROM events)"

_PLACE = {"elevation_m": "greatest({p}_acctbal, 0) / 100", "lat": "33 + ({k} * 37 % 100) / 10.0e0", "lon": "11 + ({k} * 53 % 210) / 10.0e0", "coast_km": "({p}_nationkey % 10) / 1.0e0", "is_island": "({p}_nationkey % 2 = 0)", "northness": "cos({k})"}


def _place(p: str, k: str, name: str) -> list[str]:
    return [f"{k} AS {name}", *[f"{e.format(p=p, k=k)} AS {c}" for c, e in _PLACE.items()]]


def stations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(*_place("s", "s_suppkey", "station_id"), "s_nationkey AS nationkey")


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*_place("c", "c_custkey", "id"))


STATIONS = f"stations AS (SELECT {', '.join(_place('s', 's_suppkey', 'station_id'))}, s_nationkey AS nationkey FROM supplier)"
TARGETS = f"targets AS (SELECT {', '.join(_place('c', 'c_custkey', 'id'))} FROM customer)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """A raster: cell_id, x, y, elevation and land mask; and its coordinates lon, lat."""
    return table(spark, d, "part").selectExpr("p_partkey AS cell_id", "cast(p_partkey % 50 as int) AS x", "cast(p_partkey div 50 as int) AS y", "p_retailprice AS v", "p_size >= 25 AS is_land", "11 + (p_partkey % 50) * 0.42e0 AS lon", "33 + (p_partkey div 50) * 0.25e0 AS lat")


GRID = "grid AS (SELECT p_partkey AS cell_id, (p_partkey % 50)::INT AS x, (p_partkey // 50)::INT AS y, p_retailprice AS v, p_size >= 25 AS is_land, 11 + (p_partkey % 50) * 0.42e0 AS lon, 33 + (p_partkey // 50) * 0.25e0 AS lat FROM part)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """A coastline of segments between consecutive cells of the whole raster."""
    g = grid(spark, d)
    n = g.select((F.col("cell_id") - 1).alias("cell_id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return g.join(n, "cell_id").select(F.col("cell_id").alias("seg"), F.col("lon").alias("x1"), (F.col("lat") + F.col("v") / 1000).alias("y1"), "x2", F.col("y2").alias("y2"))


SEGMENTS = GRID + ", segments AS (SELECT g.cell_id AS seg, g.lon AS x1, g.lat + g.v / 1000 AS y1, n.lon AS x2, n.lat AS y2 FROM grid g JOIN grid n ON n.cell_id - 1 = g.cell_id)"

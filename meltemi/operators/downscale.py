"""From station days and predictors to training rows, and from predictions to the daily product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.functions import weather as wx
from meltemi.operators.align import left_wins
from meltemi.operators.zones import training_weights

KEYS = ["station_id", "date"]

# Which prediction stands for each daily variable.
DAILY = {"tmean_c": "tmean_p50", "tmin_c": "tmin_p50", "tmax_c": "tmax_p50", "rh_pct": "rh_p50", "wind_ms": "wind_mean", "gust_ms": "gust_mean"}


def donor_pairs(obs: DataFrame, predictors: DataFrame, observed: str, modelled: str) -> DataFrame:
    """Station days that have both: keys, doy, obs, mdl; one equi-join on the keys."""
    left = obs.select(*KEYS, F.col(observed).alias("obs"))
    return left.join(predictors.select(*KEYS, F.col(modelled).alias("mdl")), KEYS).withColumn("doy", F.dayofyear("date"))


def with_predictors(obs: DataFrame, predictors: DataFrame) -> DataFrame:
    """Station days joined with their predictors; columns of both are the observations', those of the predictors end in _cerra."""
    return left_wins(obs, predictors, KEYS, "inner", "_cerra")


def training_table(obs: DataFrame, predictors: DataFrame, geo: DataFrame, similarity: DataFrame, member: DataFrame) -> DataFrame:
    """One row by station day with predictors, place, derived features and zone weights of mean 1.

    Features whose sources are absent are neutral: no elevation difference, gust factor 1, no alignment.
    """
    df = left_wins(with_predictors(obs, predictors), geo, ["station_id"])
    has = lambda *c: set(c) <= set(df.columns)
    sin, cos = wx.month_harmonics(F.col("date"))
    df = df.withColumns({"month_sin": sin, "month_cos": cos, "delta_elev_m": F.col("elevation_m") - F.col("cerra_elev_m") if has("elevation_m", "cerra_elev_m") else F.lit(0.0)})
    align = wx_align(df) if has("cerra_u10", "cerra_v10", "dem_eastness", "dem_northness") else F.lit(0.0)
    gust = wx.gust_factor(F.col("cerra_gust"), F.col("cerra_wind")) if has("cerra_gust", "cerra_wind") else F.lit(1.0)
    df = df.withColumns({"lapse_correction_c": wx.lapse_correction(F.col("delta_elev_m"), F.col("date")), "gust_factor_cerra": gust, "wind_terrain_align": align})
    return training_weights(df, similarity, member)


def wx_align(df: DataFrame):
    return F.col("cerra_u10") * F.col("dem_eastness") + F.col("cerra_v10") * F.col("dem_northness")


def fold_result(obs: DataFrame, predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """A fold's station days with a prediction, and the baseline where there is one."""
    return obs.join(predictions, KEYS).join(baseline, KEYS, "left")


def pooled_donors(df: DataFrame, least_stations: int = 5, least_rows: int = 1000) -> DataFrame:
    """Variables (variable, n_stations, n_rows) that may be trained: enough stations and enough rows."""
    n = df.groupBy("variable").agg(F.count_distinct("station_id").alias("n_stations"), F.count("*").alias("n_rows"))
    return n.where((F.col("n_stations") >= least_stations) & (F.col("n_rows") >= least_rows))


def required(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"predictions lack {missing}")


def daily_best(df: DataFrame, keys: list[str]) -> DataFrame:
    """The daily product: the point estimate of each variable under its own name, and precip_mm.

    Precipitation is the mapped amount, missing as dry, where predictions have it; else occurrence times mean amount,
    missing where either is. A missing source column raises.
    """
    required(df, [*keys, *DAILY.values()])
    if "precip_best_eqm" in df.columns:
        amount = F.coalesce(F.col("precip_best_eqm"), F.lit(0.0))
    else:
        required(df, ["precip_occurrence_prob", "precip_mean"])
        amount = wx.hurdle_amount(F.col("precip_occurrence_prob"), F.col("precip_mean"))
    return df.select(*keys, *[F.col(c).alias(n) for n, c in DAILY.items()], amount.alias("precip_mm"))


def of_source(df: DataFrame, source: str) -> DataFrame:
    """The rows of one source, without the column that names it."""
    return df.where(F.col("source") == source).drop("source")

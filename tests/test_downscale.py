"""Training rows and the daily product on small tables, with gaps and clashing columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meltemi.operators import downscale as ds


def test_pairs_and_folds(spark):
    day = lambda k: dt.date(2001, 3, k)
    obs = spark.createDataFrame([(1, day(1), 2.0), (1, day(2), None), (2, day(1), 4.0)], "station_id int, date date, p double")
    mdl = spark.createDataFrame([(1, day(1), 7.0), (1, day(2), 8.0), (3, day(1), 9.0)], "station_id int, date date, p double")
    assert sorted((r.station_id, r.doy, r.obs, r.mdl) for r in ds.donor_pairs(obs, mdl, "p", "p").collect()) == [(1, 60, 2.0, 7.0), (1, 61, None, 8.0)]
    assert ds.with_predictors(obs, mdl).columns == ["station_id", "date", "p", "p_cerra"]
    pred = obs.select("station_id", "date", F.lit(1.0).alias("q")).where("station_id = 1")
    got = ds.fold_result(obs, pred, mdl.withColumnRenamed("p", "base")).collect()
    assert sorted((r.station_id, r.date.day, r.base) for r in got) == [(1, 1, 7.0), (1, 2, 8.0)]


def test_daily_product(spark):
    base = spark.range(2).select(F.col("id").alias("k"), *[F.col("id").cast("double").alias(c) for c in ds.DAILY.values()])
    with pytest.raises(KeyError):
        ds.daily_best(base, ["k"])
    hurdle = base.withColumns({"precip_occurrence_prob": F.lit(0.5), "precip_mean": F.when(F.col("k") > 0, 6.0)})
    assert [r.precip_mm for r in ds.daily_best(hurdle, ["k"]).orderBy("k").collect()] == [None, 3.0]
    mapped = hurdle.withColumn("precip_best_eqm", F.when(F.col("k") > 0, 9.0))
    assert [r.precip_mm for r in ds.daily_best(mapped, ["k"]).orderBy("k").collect()] == [0.0, 9.0]
    with pytest.raises(KeyError):
        ds.daily_best(mapped.drop("rh_p50"), ["k"])


def test_training_rows_without_optional_predictors(spark):
    day = dt.date(2001, 7, 1)
    obs = spark.createDataFrame([(1, day, 2.0), (2, day, 4.0)], "station_id int, date date, p double")
    mdl = spark.createDataFrame([(1, day, 7.0), (2, day, 8.0)], "station_id int, date date, cerra_precip double")
    geo = spark.createDataFrame([(1, 10.0)], "station_id int, elevation_m double")
    none = spark.createDataFrame([], "station_id int, zone int, weight double")
    member = spark.createDataFrame([], "station_id int, zone_0 double, zone_1 double, zone_2 double, zone_3 double")
    rows = ds.training_table(obs, mdl, geo, none, member).collect()
    assert {(r.delta_elev_m, r.gust_factor_cerra, r.wind_terrain_align, r.zone_weight_0) for r in rows} == {(0.0, 1.0, 0.0, 1.0)}

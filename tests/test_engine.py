import struct

import pytest
from pyspark.sql import functions as F

from meltemi.operators import align, indices, raster, skill, spatial, zones
from meltemi.sources import files, stations
from meltemi.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_skill_edges(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 1.0, None), ("b", 1.0, 1.0), ("b", 2.0, 2.5), ("b", 3.0, 2.5), ("c", 1.0, 1.0), ("c", 1.0, 1.5), ("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, o double, p double")
    got = {r.s: r for r in df.groupBy("s").agg(*skill.continuous(F.col("o"), F.col("p"))).collect()}
    assert got["a"].n == 2 and got["a"].RMSE is None
    assert abs(got["b"].R2 - 0.75) < 1e-12 and got["c"].R2 is None and abs(got["c"].Bias - 0.5) < 1e-12
    none = df.groupBy("s").agg(*skill.contingency(F.col("o") > 9, F.col("p") > 9)).first()
    assert none.POD is None and none.FAR is None and none.CSI is None and none.H == 0


def test_aridity_and_thresholds(spark):
    df = spark.createDataFrame([(1, d, -5.0, 3.0) for d in ("2001-01-05", "2001-07-05")], "k int, d string, t double, p double").withColumn("d", F.to_date("d"))
    assert indices.aridity(df, ["k"], "d", "t", "p").first().aridity is None
    few = spark.createDataFrame([(float(i),) for i in range(5)], "p double")
    assert few.agg(indices.r99p_threshold(F.col("p"))).first()[0] == 999.0
    with pytest.raises(ValueError):
        indices.annual_stat("count_eq:1", F.col("p"))


def test_zones_sum_to_one(spark):
    df = spark.createDataFrame([(0.5, 20.0, 0.3), (900.0, 0.0, None)], "coast_km double, elevation_m double, northness double")
    for r in zones.memberships(df).collect():
        assert abs(sum(r[f"zone_{k}"] for k in range(4)) - 1) < 1e-12


def test_terrain(spark):
    g = spark.createDataFrame([(x, y, 2.0 * x) for x in range(9) for y in range(9)], "x int, y int, v double")
    s = {(r.x, r.y): r for r in spatial.slopes(g, px=1.0, py=1.0).collect()}
    assert abs(s[4, 4].slope_deg - 63.43494882) < 1e-6 and s[0, 4].slope_deg == 0.0
    t = raster.terrain(spark.createDataFrame([(1, 4, 4)], "id int, x int, y int"), g, px=250.0, py=250.0).first()
    assert abs(t.tpi_500) < 1e-9 and 0 <= t.svf <= 1


def test_station_files(spark, tmp_path):
    (tmp_path / "2001").mkdir()
    (tmp_path / "2001" / "s1.csv").write_text("STATION,DATE,LATITUDE,LONGITUDE,TEMP,PRCP,DEWP\n 1 ,2001-01-02,35,20,50.0,0.10,41\n1,bad,35,20,50,0.1,1\n1,2001-01-03,35,20,9999.9,99.99,9999.9\n2,2001-01-03,80,20,50,9,1\n")
    rows = sorted(stations.read_stations(spark, str(tmp_path), 2000, 2002).collect(), key=lambda r: r.date)
    assert [r.station_id for r in rows] == ["1", "1"]
    assert abs(rows[0].tmean_c - 10) < 1e-9 and abs(rows[0].prcp_mm - 2.54) < 1e-9 and rows[1].tmean_c is None and rows[1].prcp_mm is None
    assert stations.read_stations(spark, str(tmp_path), 1990, 1991).count() == 0


def test_series_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("m", "h", 1981, 2, 30, "360_day", 1.0), ("m", "h", 1980, 12, 31, "standard", 2.0)], "model string, scenario string, year int, month int, day int, calendar string, tmean double")
    files.write_series(df, str(tmp_path / "s"))
    assert sorted(r.doy for r in files.read_series(spark, str(tmp_path / "s")).collect()) == [60, 365]
    long = spark.createDataFrame([("m", "h", "a", 1.0), ("m", "h", "b", 2.0)], "model string, scenario string, var string, v double")
    files.upsert_variables(long, str(tmp_path / "u"))
    files.upsert_variables(long.where("var = 'a'").withColumn("v", F.lit(9.0)), str(tmp_path / "u"))
    assert {(r["var"], r.v) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {("a", 9.0), ("b", 2.0)}


def test_row_numbers_and_checks(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k")).repartition(7)
    assert all(r.k == r.id for r in files.numbered(df, "k").collect())
    with pytest.raises(KeyError):
        files.required(df, ["k", "z"])
    with pytest.raises(ValueError):
        align.assert_all_months(spark.createDataFrame([("2001-01-01",)], "d string").withColumn("d", F.to_date("d")), "d", "x")


def test_shapefile(spark, tmp_path):
    xy = [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    body = struct.pack("<i4d2i", 3, 1, 2, 5, 6, 2, 3) + struct.pack("<2i", 0, 2) + b"".join(struct.pack("<2d", *p) for p in xy)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    got = [tuple(r) for r in files.polylines(spark, str(tmp_path / "a.shp")).orderBy("part", "seq").collect()]
    assert got == [(1, 0, 0, 1.0, 2.0), (1, 0, 1, 3.0, 4.0), (1, 1, 0, 5.0, 6.0)]
    assert files.polylines(spark, str(tmp_path / "a.shp"), (50, 60, 0, 9)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("id"), "ts", "value")
    src.write.parquet(str(tmp_path / "in"))
    end = src.agg(F.max("ts")).first()[0]
    q = ingest.to_parquet(ingest.daily_stream(ingest.event_stream(spark, str(tmp_path / "in"), src.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.id, r.date): r.value_max for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.id, r.date): r.value_max for r in indices.daily(src, "id", "ts", "value").collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and max(k[1] for k in got) < end.date()


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80

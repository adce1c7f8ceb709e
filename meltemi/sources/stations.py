"""Daily station summaries from a tree of CSV files, <year>/<station>.csv."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.functions import weather as wx

REQUIRED = ("STATION", "DATE", "LATITUDE", "LONGITUDE")
OPTIONAL = ("ELEVATION", "NAME", "TEMP", "MIN", "MAX", "DEWP", "PRCP", "WDSP", "GUST")
#: Columns of a file that are read; a longer header is an error.
MOST_COLUMNS = 64
# What stands for a missing value in each column.
SENTINELS = {"TEMP": 9999.9, "MIN": 9999.9, "MAX": 9999.9, "DEWP": 9999.9, "PRCP": 99.99, "WDSP": 999.9, "GUST": 999.9}
SCHEMA = "station_id string, date date, lat double, lon double, elevation_m double, name string, tmean_c double, tmin_c double, tmax_c double, rh_pct double, prcp_mm double, wdsp_ms double, gust_ms double"


def parsed(raw: DataFrame) -> DataFrame:
    """Station days in SI units from rows of text columns; rows without station, date or place are dropped."""
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise KeyError(f"missing {', '.join(missing)}")
    raw = raw.select(*REQUIRED, *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL])
    v = {c: wx.masked(F.col(c), s) for c, s in SENTINELS.items()}
    number = lambda c: F.trim(c).try_cast("double")
    t, td = wx.f_to_c(v["TEMP"]), wx.f_to_c(v["DEWP"])
    out = raw.select(
        F.trim("STATION").alias("station_id"),
        F.try_to_timestamp(F.trim("DATE"), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        number("LATITUDE").alias("lat"),
        number("LONGITUDE").alias("lon"),
        number("ELEVATION").alias("elevation_m"),
        F.trim("NAME").alias("name"),
        t.alias("tmean_c"),
        wx.f_to_c(v["MIN"]).alias("tmin_c"),
        wx.f_to_c(v["MAX"]).alias("tmax_c"),
        wx.rh_from_dewpoint(t, td).alias("rh_pct"),
        wx.inches_to_mm(v["PRCP"]).alias("prcp_mm"),
        wx.knots_to_ms(v["WDSP"]).alias("wdsp_ms"),
        wx.knots_to_ms(v["GUST"]).alias("gust_ms"),
    )
    return out.dropna(subset=["station_id", "date", "lat", "lon"])


def within(df: DataFrame, lat=(33.0, 43.0), lon=(11.0, 32.0)) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def with_rain(df: DataFrame, prcp: str = "prcp_mm", least: float = 0.1, key: str = "station_id") -> DataFrame:
    """Rows of stations that exceed `least` on some day."""
    wet = df.groupBy(key).agg(F.bool_or(F.coalesce(F.col(prcp) > least, F.lit(False))).alias("_wet")).where("_wet").select(key)
    return df.join(wet, key, "left_semi")


def read_stations(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Station days of the years first to last; years without a folder are skipped, unreadable files too.

    Each file is read by its own header, so columns may be in any order and optional ones absent; rows of a file without a
    required column are dropped. A header of more than MOST_COLUMNS columns is an error.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [p for p in (f"{root}/{y}" for y in range(first, last + 1)) if fs.exists(fs_path(p))]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    columns = [f"_c{k}" for k in range(MOST_COLUMNS)]
    raw = spark.read.option("ignoreCorruptFiles", "true").csv(paths, header=False, schema=", ".join(f"{c} string" for c in [*columns, "_whole"]), mode="PERMISSIVE", columnNameOfCorruptRecord="_whole", ignoreLeadingWhiteSpace=True)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.transform(F.array(*columns), lambda x: F.trim(x)).alias("c"), "_whole")
    lines = lines.withColumn("head", F.coalesce(F.array_contains("c", "STATION"), F.lit(False)))
    # Of a line of another number of columns than asked for, Spark keeps the whole as well.
    long = F.col("head") & (F.size(F.split("_whole", ",", -1)) > MOST_COLUMNS)
    lines = lines.withColumn("c", F.when(long, F.raise_error(F.concat(F.lit(f"more than {MOST_COLUMNS} columns in "), F.col("file"))).cast("array<string>")).otherwise(F.col("c"))).drop("_whole")
    heads = lines.where("head").groupBy("file").agg(F.min("c").alias("names"))
    rows = lines.where("not head").join(heads, "file")
    place = lambda c: F.coalesce(F.array_position("names", c), F.lit(0)).cast("int")
    named = rows.select(*[F.when(place(c) > 0, F.get("c", place(c) - 1)).alias(c) for c in REQUIRED + OPTIONAL])
    return with_rain(within(parsed(named)))

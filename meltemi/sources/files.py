"""Readers and writers of the engine's files, and what can be read off their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltemi.functions.numeric import finite
from meltemi.scratch import written

_RANGE = r"_day_(\d{4})\d{4}-(\d{4})\d{4}[.]nc$"
FILL = 1e20


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with id from 0 in the given order. Files have no row order in Spark, so the order is always named.

    The rank within each of a range of the order's partitions is added to the count of rows before it: no single task,
    unlike a window over everything. The ranges come from a sample, so they are written once and both counts and ranks
    are read from there.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row for each partition.
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", rank).join(F.broadcast(starts), "_p").withColumn("id", (F.col("_start") + F.col("_r")).cast("long")).drop("_p", "_r", "_start")


def links(pages: DataFrame, html: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Distinct link targets that start and end as given."""
    out = pages.select(F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)).alias("link")).distinct()
    return out.where(F.col("link").startswith(prefix) & F.col("link").endswith(suffix)) if prefix or suffix else out


def overlapping(files: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Files whose name states a range of days that meets the years first to last."""
    y = [F.regexp_extract(name, _RANGE, i).try_cast("int") for i in (1, 2)]
    out = files.select("*", y[0].alias("first_year"), y[1].alias("last_year"))
    return out.where((F.col("first_year") <= last) & (F.col("last_year") >= first))


def target_grid(spark: SparkSession, path: str) -> DataFrame:
    """id (from 0 by file and line), lon, lat, elevation_m of a CSV with columns lon, lat, VALUE."""
    raw = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    rows = raw.select(*[F.col(c).try_cast("double").alias(a) for c, a in (("lon", "lon"), ("lat", "lat"), ("VALUE", "elevation_m"))], F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(rows, "_f", "_b", "_i").select("id", "lon", "lat", "elevation_m")


def static_grid(df: DataFrame, land: str | None = "lsm", threshold: float = 0.5, height: str | None = None, above: bool = False) -> DataFrame:
    """Grid cells with is_land and elevation_m; geopotential above 10,000 becomes metres.

    Land is at or above the threshold; of a model's land share in percent, strictly above 50: threshold=50, above=True.
    """
    if land:
        df = df.withColumn("is_land", (F.col(land) > threshold) if above else (F.col(land) >= threshold))
    if height:
        top = df.agg(F.max(height).alias("_top"))
        df = df.join(F.broadcast(top)).withColumn("elevation_m", F.when(F.col("_top") > 10_000, F.col(height) / 9.80665).otherwise(F.col(height))).drop("_top")
    return df


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and fill values become null."""
    return df.select(*[F.when(F.abs(finite(F.col(c))) < FILL, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def discovered(spark: SparkSession, folder: str, short: set[str] = frozenset(), scenarios: tuple[str, ...] = ("historical",)) -> DataFrame:
    """(member, scenario, path, short_year) of the corrected files <member>_bc_<scenario>.nc in a folder, by member.

    A member counts if it has a file of the first scenario; `short` names those of 360 days a year. Without any member
    it is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_bc_*.nc").load(folder).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)_bc_([^/]+)[.]nc$", i)
    found = files.select(part(1).alias("member"), part(2).alias("scenario"), "path").where((F.col("member") != "") & F.col("scenario").isin(*scenarios))
    base = found.where(F.col("scenario") == scenarios[0]).select("member")
    if base.isEmpty():
        raise FileNotFoundError(f"no *_bc_{scenarios[0]}.nc in {folder}")
    return found.join(base, "member", "left_semi").withColumn("short_year", F.col("member").isin(*short) if short else F.lit(False)).orderBy("member", "scenario")


def write_series(df: DataFrame, path: str, by=("model", "scenario")) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def read_series(spark: SparkSession, path: str, years: tuple[int, int] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A series with its own day of year: 360-day rows count thirty days a month, day 366 joins 365.

    Only the years, and the places within box (lowest and highest lon, lowest and highest lat), are read; both reach the scan.
    """
    df = spark.read.parquet(path)
    if box:
        df = df.where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]))
    if years:
        df = df.where(F.col("year").between(*years))
    own = F.when(F.col("calendar") == "360_day", (F.col("month") - 1) * 30 + F.col("day"))
    return df.withColumn("doy", F.coalesce(own, F.least(F.dayofyear(F.make_date("year", "month", "day")), F.lit(365))))


def upsert_variables(df: DataFrame, path: str) -> None:
    """Replace only the variables that df holds; the table is partitioned by model, scenario and variable."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("model", "scenario", "var").parquet(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unfinished(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that no finished fold has."""
    return keys.join(done.select(key).distinct(), key, "left_anti")


def write_report(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """One CSV of a small report."""
    if decimals is not None:
        df = df.select(*[F.format_number(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing {', '.join(missing)}")
    return df.select(*columns)


def members(df: DataFrame, name: str) -> Column:
    """The member that a corrected historical file belongs to."""
    return F.regexp_extract(name, r"([^/]+)_bc_historical[.]nc$", 1)


def polylines(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(record, part, seq, lon, lat) of shapefiles with lines or polygons; records outside the box are skipped."""
    import struct

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for data in b["content"]:
                at = 100
                while at + 12 <= len(data):
                    rec, words = struct.unpack(">ii", data[at : at + 8])
                    body = data[at + 8 : at + 8 + 2 * words]
                    at += 8 + 2 * words
                    if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (3, 5):
                        continue
                    x0, y0, x1, y1, parts, points = struct.unpack("<4d2i", body[4:44])
                    if box and (x1 < box[0] or x0 > box[1] or y1 < box[2] or y0 > box[3]):
                        continue
                    first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                    xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                    rows += [(rec, p, i - first[p], xy[2 * i], xy[2 * i + 1]) for p in range(parts) for i in range(first[p], first[p + 1])]
            yield pd.DataFrame(rows, columns=["record", "part", "seq", "lon", "lat"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record int, part int, seq int, lon double, lat double")

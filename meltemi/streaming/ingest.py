"""Incremental ingestion: the daily statistics of the batch plans over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Files under path as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_stream(events: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """Mean, minimum and maximum by key and day; a day is final once the watermark has passed it."""
    day = F.window(ts, "1 day")
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, day).agg(F.avg(value).alias(f"{value}_avg"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"))
    return out.select(key, F.to_date("window.start").alias("date"), *[f"{value}_{s}" for s in ("avg", "min", "max")])


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table exactly once; runs until what is there has been read."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

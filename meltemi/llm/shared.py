"""Scratch tables and column choice, as the operators of this package use them."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.scratch import scratch_path, shared_dir, written

__all__ = ["bucketed", "classed", "pruned", "scratch_path", "shared_dir", "short_batches", "trimmed", "written"]

#: Rows of an Arrow batch. Spark's own ten thousand are too many where each row is a text.
ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Let Python workers get ROWS rows at a time, unless the session states another number than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ROWS))


def trimmed(batches: Iterable) -> Iterator:
    """The batches; before each next one a Python worker gives back what memory the last one left free.

    The C library keeps the space of large arrays, and Arrow's pool that of batches, for as long as the worker lives, which
    idle ones do for a minute: what one step took at most would add to what the next one takes.
    """
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def bucketed(df: DataFrame, name: str, column: str, rows: int) -> DataFrame:
    """df as a table in the shared folder whose rows lie in buckets of the column: grouping by it shuffles none of them.

    rows is about their number; there are as many buckets as the session's shuffles have partitions, or more.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"meltemi_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 16)
    df.write.bucketBy(n, column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    # The relation is resolved, and the files of an external table stay where they are.
    out.schema  # noqa: B018
    spark.sql(f"DROP TABLE {table}")
    return out


def pruned(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched exactly, so that extra columns of clashing names do no harm."""
    return df.select(*[df[f"`{n}`"] for n in names])


#: A class with at least a thousandth of the rows is hot; there are at most so many.
HOT = 1000


def classed(rows: DataFrame, classes: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to their class; classes has one row for each key and in n the number of rows that have it.

    Keys that hold a thousandth of all `total` rows are at most a thousand, so they are broadcast and their rows stay
    where they are; the rest meet by a shuffle in which no key is large. key is not null. how: inner or left.
    """
    hot = F.broadcast(classes.where(F.col("n") * HOT >= total))
    rest = rows.join(hot.select(key), key, "left_anti").join(classes.where(F.col("n") * HOT < total), key, how)
    return rows.join(hot, key).unionByName(rest)

"""Alignment and deduplication of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned(frames: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """One column of each frame's value by key, as a full join of all would give; a single shuffle for any number of frames."""
    long = [f.select(*keys, F.lit(name).alias("_n"), F.col(value).alias("_v")) for name, f in frames.items()]
    return reduce(DataFrame.unionByName, long).groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in frames])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by a partial aggregation instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    s = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(s).alias("_s")).select(*keys, "_s.*").select(*df.columns)


def feature_matrix(series: DataFrame, features: DataFrame, date: str = "date", key: str = "id") -> DataFrame:
    """One row a date and place with the features of the place; of repeated rows the least by their other columns counts.

    Places without features keep their rows, with nulls.
    """
    least = lambda df, keys: first_by(df, keys, [c for c in df.columns if c not in keys])
    return least(series, [date, key]).join(least(features, [key]), key, "left")


def left_wins(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", suffix: str = "_geo") -> DataFrame:
    """A join in which the right side's columns that the left has too get a suffix."""
    both = set(left.columns) & set(right.columns) - set(on)
    return left.join(right.select(*[F.col(c).alias(c + suffix) if c in both else F.col(c) for c in right.columns]), on, how)


def missing_months(df: DataFrame, key: str, date: str) -> DataFrame:
    """(key, n_missing): calendar months that a key has no row of."""
    return df.groupBy(key).agg((12 - F.count_distinct(F.month(date))).cast("long").alias("n_missing"))


def assert_all_months(df: DataFrame, date: str, label: str) -> None:
    """ValueError naming the calendar months without rows; at most twelve values come to the driver."""
    have = {r[0] for r in df.select(F.month(date)).distinct().collect()}
    if missing := sorted(set(range(1, 13)) - have):
        raise ValueError(f"{label}: no rows in months {missing}")


def present_and_missing(groups: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """groups with missing: whether no row of `have` has the key."""
    return groups.join(have.select(key).distinct().withColumn("_have", F.lit(True)), key, "left").withColumn("missing", F.col("_have").isNull()).drop("_have")


def mean_one(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """column divided by its mean (over keys): all 1 where the mean is 0. The mean comes from an aggregation, not from one window over all rows."""
    if keys:
        w = Window.partitionBy(*keys)
        m = F.avg(column).over(w)
        return df.withColumn(column, F.when(m == 0, F.lit(1.0)).otherwise(F.col(column) / F.nullif(m, F.lit(0.0))))
    mean = df.agg(F.avg(column).alias("_m"))
    return df.join(F.broadcast(mean)).withColumn(column, F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.col(column) / F.nullif(F.col("_m"), F.lit(0.0)))).drop("_m")

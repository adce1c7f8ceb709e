"""Skill of predictions: continuous scores, contingency tables, pooled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.numeric import count_if, ratio


def pooled(df: DataFrame, station: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """aggs by keys for every station and, as station ALL, over all pairs; one expansion, one shuffle."""
    sets = [[F.col(station), *map(F.col, keys)], list(map(F.col, keys))]
    g = df.groupingSets(sets, F.col(station), *map(F.col, keys)).agg(*aggs, F.grouping(station).alias("_all"))
    return g.withColumn(station, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(station).cast("string"))).drop("_all")


def continuous(obs: Column, pred: Column, least: int = 3) -> list[Column]:
    """R2 (of the sums of squares, so possibly negative), RMSE, Bias and n over pairs without null."""
    ok = obs.isNotNull() & pred.isNotNull()
    o, e = F.when(ok, obs), F.when(ok, pred - obs)
    n = F.count(o)
    few = n < least
    ss = F.var_pop(o) * n
    return [
        F.when(~few & (ss > 1e-12), 1 - F.sum(e * e) / ss).alias("R2"),
        F.when(~few, F.sqrt(F.avg(e * e))).alias("RMSE"),
        F.when(~few, F.avg(e)).alias("Bias"),
        n.alias("n"),
    ]


def contingency(obs: Column, pred: Column) -> list[Column]:
    """POD, FAR, CSI with null for empty denominators, and H, M, F."""
    h, m, f = count_if(obs & pred), count_if(obs & ~pred), count_if(~obs & pred)
    d = lambda x: x.cast("double")
    return [
        ratio(d(h), d(h + m)).alias("POD"),
        ratio(d(f), d(h + f)).alias("FAR"),
        ratio(d(h), d(h + m + f)).alias("CSI"),
        h.alias("H"),
        m.alias("M"),
        f.alias("F"),
        (h + m).alias("n_obs_events"),
    ]


def matched(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null."""
    return df.dropna(subset=list(columns))


def extreme_weight(y: Column, wet: Column, factor: float = 6.0) -> Column:
    """factor above the P95 of wet values (over the whole frame's window), else 1."""
    return F.when(y > wet, F.lit(factor)).otherwise(F.lit(1.0))

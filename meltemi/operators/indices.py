"""Daily, monthly and annual aggregation and climate indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.numeric import count_if, event, let, ratio, total

# Events of the indices, as variable, comparison and threshold; null is a station's own P99.
EVENTS = {"pr20": ("prcp", ">", 20.0), "pr50": ("prcp", ">", 50.0), "r99p": ("prcp", ">", None), "tmax35": ("tmax", ">", 35.0), "tmax37": ("tmax", ">", 37.0), "tmin0": ("tmin", "<", 0.0)}
MEANS = ("tmean", "tmin", "tmax", "wind", "gust")


def circular_mean(degrees: Column) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def daily(df: DataFrame, key: str, ts: str, value: str, stats=("avg", "min", "max"), day: Column | None = None) -> DataFrame:
    """One row by key and day with the given statistics of a value."""
    day = F.to_date(ts) if day is None else day
    return df.groupBy(key, day.alias("date")).agg(*[getattr(F, s)(value).alias(f"{value}_{s}") for s in stats])


def monthly_climatology(df: DataFrame, key: str, date: str, value: str, prefix: str) -> DataFrame:
    """Mean of each calendar month as columns prefix_m01 to prefix_m12, by one aggregation."""
    m = F.month(date)
    return df.groupBy(key).agg(*[F.avg(F.when(m == i, F.col(value))).alias(f"{prefix}_m{i:02d}") for i in range(1, 13)])


def r99p_threshold(prcp: Column, wet: float = 1.0, least: int = 10, default: float = 999.0) -> Column:
    """Exact P99 of wet days; the default where there are no more than `least` of them."""
    v = F.when(prcp > wet, prcp)
    return F.when(F.count(v) > least, F.percentile(v, 0.99)).otherwise(F.lit(default))


def index_columns(source: str, available: list[str], r99p: Column) -> list[Column]:
    """Means, total and event counts of one source's variables, those that are available."""
    c = lambda v: F.col(f"{source}_{v}")
    out = [F.avg(c(v)).alias(f"{source}_{v}") for v in MEANS if f"{source}_{v}" in available]
    if f"{source}_prcp" in available:
        out.append(total(c("prcp")).alias(f"{source}_precip"))
    for name, (v, op, thr) in EVENTS.items():
        if f"{source}_{v}" in available:
            out.append(count_if(event(c(v), op, r99p if thr is None else thr)).alias(f"{source}_{name}"))
    return out


def period_indices(df: DataFrame, keys: list, sources=("obs", "pred", "base"), r99p: str = "r99p_threshold") -> DataFrame:
    """All indices of all sources in one aggregation by keys."""
    return df.groupBy(*keys).agg(*[x for s in sources for x in index_columns(s, df.columns, F.col(r99p))])


def annual_stat(spec: str, c: Column) -> Column:
    """annual_mean, annual_sum, count_gt:N or count_lt:N."""
    if spec == "annual_mean":
        return F.avg(c)
    if spec == "annual_sum":
        return total(c)
    kind, _, n = spec.partition(":")
    if kind in ("count_gt", "count_lt"):
        return count_if(event(c, ">" if kind == "count_gt" else "<", float(n))).cast("double")
    raise ValueError(f"unknown statistic {spec!r}")


def thornthwaite_pet(months: list[Column]) -> Column:
    """Annual potential evapotranspiration from twelve monthly means in degrees C, those missing counted as 0."""
    t = F.array(*[F.greatest(F.coalesce(m, F.lit(0.0)), F.lit(0.0)) for m in months])
    added = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    def pet(i: Column) -> Column:
        a = 6.75e-7 * F.pow(i, F.lit(3.0)) - 7.71e-5 * F.pow(i, F.lit(2.0)) + 1.792e-2 * i + 0.49239
        return let(a, lambda e: added(t, lambda x: F.when(x > 0, 16.0 * F.pow(10.0 * x / F.nullif(i, F.lit(0.0)), e)).otherwise(0.0)))

    return let(added(t, lambda x: F.when(x > 0, F.pow(x / 5.0, F.lit(1.514))).otherwise(0.0)), pet)


def aridity(df: DataFrame, keys: list[str], date: str, tmean: str, prcp: str) -> DataFrame:
    """Annual precipitation by potential evapotranspiration, null where the latter is 0; one shuffle by keys."""
    return aridities(df, keys, date, {"own": (tmean, prcp)}).withColumnRenamed("own_aridity", "aridity")


def aridities(df: DataFrame, keys: list[str], date: str, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """keys and <source>_aridity for each source's (temperature, precipitation) columns, as aridity() has it; one shuffle for all.

    Values are summed in whole units of 1e-12, the same in any order of the rows. A month whose mean can't be told from 0 is
    0: what rounding leaves of it would count as a warm month, which in a year without another is all the evaporation.
    """
    m = F.month(date)
    units = lambda c: F.rint(F.col(c) * 1e12).cast("long")
    d = df.select(*keys, m.alias("_m"), *[x for s, (t, p) in sources.items() for x in (units(t).alias(f"_u_{s}"), units(p).alias(f"_w_{s}"))])

    def mean(c: Column) -> Column:
        # Each value is at most about half a unit off.
        return F.when(F.abs(F.sum(c)) > F.count(c), F.sum(c).cast("double") / 1e12 / F.count(c)).when(F.count(c) > 0, 0.0)

    sums = [(F.coalesce(F.sum(f"_w_{s}"), F.lit(0)).cast("double") / 1e12).alias(f"_p_{s}") for s in sources]
    months = [mean(F.when(F.col("_m") == i, F.col(f"_u_{s}"))).alias(f"_t_{s}_{i}") for s in sources for i in range(1, 13)]
    g = d.groupBy(*keys).agg(*sums, *months)
    # Evaporation is a column of its own before it divides, or it would be worked out twice.
    g = g.select(*keys, *[f"_p_{s}" for s in sources], *[thornthwaite_pet([F.col(f"_t_{s}_{i}") for i in range(1, 13)]).alias(f"_e_{s}") for s in sources])
    return g.select(*keys, *[F.when(F.col(f"_e_{s}") > 0, ratio(F.col(f"_p_{s}"), F.col(f"_e_{s}"))).alias(f"{s}_aridity") for s in sources])


def complete_years(df: DataFrame, keys: list[str], year: str, step: str, least: int = 340) -> DataFrame:
    """Keys and years with at least `least` distinct steps."""
    return df.groupBy(*keys, year).agg(F.count_distinct(step).alias("n_steps")).where(F.col("n_steps") >= least).drop("n_steps")


def ensemble_mean(df: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """Mean over each member's years, then over members alike."""
    return df.groupBy(*keys, member).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias(value))

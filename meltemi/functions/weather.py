"""Unit conversions and derived weather variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltemi.functions.numeric import clip, pmax, pmin, ratio

# Lapse rates in degrees per km from January to December.
LAPSE_RATES = (-4.5, -4.8, -5.2, -5.5, -5.8, -6.2, -6.5, -6.5, -6.0, -5.5, -5.0, -4.7)


def f_to_c(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def inches_to_mm(c: Column) -> Column:
    return c * 25.4


def knots_to_ms(c: Column) -> Column:
    return c * 0.514444


def k_to_c(c: Column) -> Column:
    return c - 273.15


def flux_to_mm_day(c: Column) -> Column:
    return c * 86400.0


def m_to_mm(c: Column) -> Column:
    return c * 1000.0


def masked(raw: Column, sentinel: float) -> Column:
    """A number from text with trailing flags; null if it isn't one or not below the sentinel."""
    v = F.rtrim(raw, F.lit("* ")).try_cast("double")
    return F.when(v < sentinel, v)


def rh_from_dewpoint(t: Column, td: Column) -> Column:
    """Relative humidity in percent from temperatures in degrees C (Magnus)."""
    e = lambda x: F.exp(17.625 * x / (243.04 + x))
    return clip(100.0 * e(td) / e(t), 0.0, 100.0)


def rh_from_specific(q: Column, t_k: Column, p_pa: Column) -> Column:
    """Relative humidity in percent from specific humidity, temperature in K and pressure (null: 101325 Pa)."""
    t = k_to_c(t_k)
    es = 611.2 * F.exp(17.67 * t / (t + 243.5))
    e = q * F.coalesce(p_pa, F.lit(101325.0)) / (0.622 + 0.378 * q)
    return clip(100.0 * e / es, 0.0, 100.0)


def wind_u(speed: Column, degrees: Column) -> Column:
    return -speed * F.sin(F.radians(degrees))


def wind_v(speed: Column, degrees: Column) -> Column:
    return -speed * F.cos(F.radians(degrees))


def month_harmonics(date: Column) -> tuple[Column, Column]:
    a = 2.0 * F.pi() * F.month(date) / 12.0
    return F.sin(a), F.cos(a)


def lapse_correction(delta_m: Column, date: Column) -> Column:
    rates = F.array(*map(F.lit, LAPSE_RATES))
    return delta_m * F.get(rates, F.month(date) - 1) / 1000.0


def gust_factor(gust: Column, wind: Column) -> Column:
    """gust / wind within [1, 10]; 1 where either is missing or wind is 0."""
    r = ratio(gust, wind)
    return F.coalesce(clip(r, 1.0, 10.0), F.lit(1.0))


def ordered_temperatures(tmin: Column, tmean: Column, tmax: Column) -> tuple[Column, Column]:
    """tmin no higher and tmax no lower than tmean."""
    return pmin(tmin, tmean), pmax(tmax, tmean)


def ordered_quantiles(*q: Column) -> list[Column]:
    """The values ascending, nulls last."""
    a = F.array_sort(F.array(*q))
    return [F.get(a, F.lit(i)) for i in range(len(q))]


# Limits of each variable.
LIMITS = {"rh": (0.0, 100.0), "wind": (0.0, None), "gust": (0.0, None), "precip": (0.0, None), "occurrence": (0.0, 1.0)}


def limited(variable: str, c: Column) -> Column:
    lo, hi = LIMITS.get(variable, (None, None))
    return c if lo is None and hi is None else clip(c, lo, hi)


def hurdle_amount(occurrence: Column, mean: Column) -> Column:
    return clip(occurrence * mean, 0.0)


def precip_estimate(columns: list[str]) -> Column:
    """The best available precipitation column, chosen by which are present."""
    if "precip_best_eqm" in columns:
        return F.col("precip_best_eqm")
    if "precip_best" in columns:
        return F.col("precip_best")
    return F.when(F.col("precip_occurrence_prob") > 0.5, F.col("precip_p50")).otherwise(0.0)


def precip_source(columns: list[str]) -> Column:
    """The amount that quantile mapping starts from."""
    if {"precip_occurrence_prob", "precip_mean"} <= set(columns):
        return hurdle_amount(F.col("precip_occurrence_prob"), F.col("precip_mean"))
    return precip_estimate([c for c in columns if c != "precip_best_eqm"])


def risk_class(elevation: Column, rise: float = 0.8) -> Column:
    """-1 below the raised sea, 0 up to 5 m above it, 1 up to 10 m, else 2."""
    a = elevation - rise
    return F.when(a < 0, -1).when(a <= 5, 0).when(a <= 10, 1).when(a > 10, 2)

"""Null-propagating arithmetic and array kernels, all as column expressions.

Missing values are NULL everywhere in the engine; sources turn NaN into NULL. The SQL functions greatest and least skip
NULL, so the helpers here restore the propagating form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(c: Column, lo=None, hi=None) -> Column:
    """c within [lo, hi]; null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, lit(lo))
    if hi is not None:
        out = F.least(out, lit(hi))
    return F.when(c.isNotNull(), out)


def pmin(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def pmax(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def quantile(values: Column, q) -> Column:
    """Linear quantile q (a number or a column) of an ascending array; null if it is empty."""
    at = lit(q) * (F.size(values) - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(values, lo), F.get(values, F.least(lo + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - lo))


def quantiles(values: Column, n: int) -> Column:
    """n linear quantiles at 0, 1/(n-1), ..., 1 of an ascending array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: quantile(values, i / (n - 1)))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear interpolation within an ascending xs; equal xs give the last of their ys, outside gives the ends."""
    n = F.size(xs)

    def at(k: Column) -> Column:
        lo, hi = F.get(xs, k - 1), F.get(xs, k)
        a, b = F.get(ys, k - 1), F.get(ys, k)
        inside = a + (b - a) * (x - lo) / (hi - lo)
        return F.when(x.isNull(), None).when(k == 0, F.get(ys, F.lit(0))).when(k == n, F.get(ys, n - 1)).otherwise(inside)

    return let(F.size(F.filter(xs, lambda v: v <= x)), at)


def rank(values: list[float], x: Column, step: int = 32) -> Column:
    """How many of ascending constants are at most x: first among every step-th, then among the step after it."""
    coarse, fine = F.array(*map(F.lit, values[::step])), F.array(*map(F.lit, values))
    le = lambda v: v <= x
    return let(F.size(F.filter(coarse, le)), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(F.slice(fine, (c - 1) * step + 1, F.lit(step)), le))))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: expressions inside conditions aren't shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gaussian(d: Column, sigma: Column) -> Column:
    """exp(-d^2 / 2 sigma^2), 1 where sigma is 0."""
    return F.when(sigma == 0, F.lit(1.0)).otherwise(F.exp(-(d * d) / (2 * sigma * sigma)))


def event(c: Column, op: str, threshold) -> Column:
    """A strict exceedance (op '>') or undercut (op '<')."""
    return c > lit(threshold) if op == ">" else c < lit(threshold)


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def total(c: Column) -> Column:
    """Sum that is 0 for no values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def shares(weights: list[Column]) -> list[Column]:
    """Weights divided by their sum; a sum of 0 leaves them."""
    s = sum(weights[1:], weights[0])
    return [w / F.when(s == 0, F.lit(1.0)).otherwise(s) for w in weights]

"""Mean of a gamma distribution from its median and P90."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meltemi.functions.numeric import let, rank


def _cdf(k: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below k + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(k * math.log(x) - x - math.lgamma(k))
    if x < k + 1:
        term = total = 1.0 / k
        n = k
        while abs(term) > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - k, 1e300
    d = h = 1.0 / b
    for i in range(1, 500):
        an = -i * (i - k)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1.0 - front * h


def ppf(p: float, k: float) -> float:
    """Quantile by bisection on the logarithm."""
    lo, hi = -400.0, math.log(k + 60 * math.sqrt(k) + 60)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cdf(k, math.exp(mid)) < p else (lo, mid)
    return math.exp((lo + hi) / 2)


@cache
def table(n: int = 800) -> tuple[list[float], list[float], list[float]]:
    """(shapes, P90 by P50, P50 at scale 1) for n shapes from 0.1 to 100, evenly spaced in their logarithm."""
    k = np.logspace(-1, 2, n)
    p50 = [ppf(0.5, x) for x in k]
    return k.tolist(), [ppf(0.9, x) / m for x, m in zip(k, p50)], p50


def _between(x: Column, xs: Column, ys: Column, i: Column) -> Column:
    lo, hi, a, b = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(i == 0, F.get(ys, F.lit(0))).when(i == F.size(xs), F.get(ys, i - 1)).otherwise(a + (b - a) * (x - lo) / (hi - lo))


def conditional_mean(p50: Column, p90: Column) -> Column:
    """shape * scale of the gamma that has both quantiles; p50 where it isn't positive or p90 isn't above it."""
    k, r, m = table()
    xs, ks, ms = (F.array(*[F.lit(round(float(v), 12)) for v in reversed(x)]) for x in (r, k, m))
    x = F.when((p50 > 0) & (p90 > p50), p90 / p50)
    # Shape and median are read off one row of the table: their quotient's parts are interpolated alike.
    pairs = let(rank([round(float(v), 12) for v in reversed(r)], x), lambda i: _between(x, xs, ks, i) * p50 / _between(x, xs, ms, i))
    return F.when(x.isNull(), p50).otherwise(pairs)

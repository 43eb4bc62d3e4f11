"""Statistics of a sorted array of doubles, as higher-order expressions: no shuffle and no Python worker.

Null where the array is empty or null, unless a function says otherwise.  A scalar that elements are compared with is bound
first: the optimizer may put its whole expression in its place, which would then be worked out per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value more than once while it is worked out once."""
    return F.transform(F.array(value), use)[0]


def percentiles(a: Column, shares: list[float]) -> Column:
    """Linear interpolation between order statistics, for each share."""
    at = lambda p: p * (F.size(a) - 1)

    def one(p: Column) -> Column:
        low = F.floor(at(p)).cast("int")
        high = F.least(low + 1, F.size(a) - 1)
        return F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (at(p) - low)

    return F.when(F.size(a) > 0, F.transform(F.array(*[F.lit(float(s)) for s in shares]), one))


def median(a: Column) -> Column:
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def median_deviation(a: Column, centre: Column) -> Column:
    """Median of the absolute differences from a centre."""
    return bind(bind(centre, lambda c: F.sort_array(F.transform(a, lambda v: F.abs(v - c)))), median)


def mean_deviation(a: Column, centre: Column) -> Column:
    total = bind(centre, lambda c: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v - c)))
    return F.try_divide(total, F.size(a))


def l_moments(a: Column) -> Column:
    """An array of the first four sample L-moments; the k-th is null with fewer than k values."""
    start = F.struct(F.lit(0).alias("i"), *[F.lit(0.0).alias(f"b{k}") for k in range(4)])

    def step(s: Column, v: Column) -> Column:
        i = s["i"].cast("double")
        return F.struct((s["i"] + 1).alias("i"), (s["b0"] + v).alias("b0"), (s["b1"] + i * v).alias("b1"), (s["b2"] + i * (i - 1) * v).alias("b2"), (s["b3"] + i * (i - 1) * (i - 2) * v).alias("b3"))

    def finish(s: Column) -> Column:
        n = s["i"].cast("double")
        b0, b1 = F.try_divide(s["b0"], n), F.try_divide(s["b1"], n * (n - 1))
        b2, b3 = F.try_divide(s["b2"], n * (n - 1) * (n - 2)), F.try_divide(s["b3"], n * (n - 1) * (n - 2) * (n - 3))
        return F.array(b0, 2 * b1 - b0, 6 * (b2 - b1) + b0, 20 * b3 - 30 * b2 + 12 * b1 - b0)

    return F.when(F.size(a) > 0, F.aggregate(a, start, step, finish))


def histogram_mode(a: Column, bins: int = 64) -> Column:
    """The left edge of the fullest of equal-width bins on [min, max], the lowest of equally full ones.

    In a sorted array the values of a bin stand together, so one pass over runs finds the fullest.
    """
    low, high = F.get(a, F.lit(0)), F.get(a, F.size(a) - 1)
    step = (high - low) / bins
    edge = lambda k: F.when(k == bins, high).otherwise(low + k * step)

    def corrected(v: Column, k: Column) -> Column:
        return F.when(v < edge(k), k - 1).when((v >= edge(k + 1)) & (k < bins - 1), k + 1).otherwise(k)

    def count(s: Column, k: Column) -> Column:
        n = F.when(k == s["k"], s["n"] + 1).otherwise(F.lit(1))
        return F.struct(k.alias("k"), n.alias("n"), F.when(n > s["most"], k).otherwise(s["best"]).alias("best"), F.greatest(n, s["most"]).alias("most"))

    start = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("n"), F.lit(-1).alias("best"), F.lit(0).alias("most"))
    near = F.transform(a, lambda v: F.least(F.floor((v - low) * (bins / (high - low))).cast("int"), F.lit(bins - 1)))
    best = F.aggregate(F.zip_with(a, near, corrected), start, count, lambda s: s["best"])
    return F.when(F.size(a) == 0, F.lit(None)).when(low == high, low).otherwise(low + best * step)


def profile_area(a: Column) -> Column:
    """Half the area under the percentiles 0..99 over the 99th, -9999 where that is not positive."""
    shares = [k / 100 for k in range(100)]

    def area(q: Column) -> Column:
        top = F.get(q, F.lit(99))
        inner = F.aggregate(F.slice(q, 2, 98), F.lit(0.0), lambda s, v: s + 2 * v / top)
        return F.when(q.isNull(), F.lit(None)).when(top > 0, 0.5 * (F.get(q, F.lit(0)) / top + inner + 1)).otherwise(F.lit(-9999.0))

    return bind(percentiles(a, shares), area)


def count_above(a: Column, limit: Column) -> Column:
    """Values over a limit; null where the limit is."""
    return bind(limit, lambda c: F.when(c.isNotNull(), F.size(F.filter(a, lambda v: v > c))))

"""Features of one series held as an array<double>, as higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; named in a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def variance(x: Column) -> Column:
    return let(x, lambda a: let(mean(a), lambda m: F.try_divide(total(F.transform(a, lambda v: (v - m) * (v - m))), F.size(a))))


def differences(x: Column) -> Column:
    """x[i+1] - x[i]."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def quantile(x: Column, q: float) -> Column:
    """Linear between the two nearest order statistics."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(low + 2, F.size(s)))
        return a + (b - a) * (at - low)

    return let(F.array_sort(x), between)


def ratio_beyond(x: Column, r: float) -> Column:
    """Share of values further than r standard deviations from the mean."""
    limits = F.struct(mean(x).alias("m"), F.sqrt(variance(x)).alias("sd"))
    return let(limits, lambda l: F.try_divide(F.size(F.filter(x, lambda v: F.abs(v - l["m"]) > r * l["sd"])), F.size(x)))


def reoccurring_share(x: Column) -> Column:
    """Share of points whose value occurs more than once."""

    def share(s: Column) -> Column:
        n = F.size(s)
        same = F.transform(
            s,
            lambda v, i: ((i > 0) & (v == F.get(s, i - 1))) | ((i < n - 1) & (v == F.get(s, i + 1))),
        )
        return F.try_divide(F.size(F.filter(same, lambda b: b)), n)

    return let(F.array_sort(x), share)


def longest_strike(x: Column, above: bool) -> Column:
    """Longest run of values above (or below) the mean."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def run(m: Column) -> Column:
        def step(a: Column, v: Column) -> Column:
            now = F.when(v > m if above else v < m, a["now"] + 1).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

        return F.aggregate(x, start, step, lambda a: a["best"])

    return let(mean(x), run)


def sum_of_changes(x: Column) -> Column:
    return F.aggregate(differences(x), F.lit(0.0), lambda a, d: a + F.abs(d))


def energy_ratio(x: Column, segment: int, segments: int = 10) -> Column:
    """Share of the energy in one of `segments` parts, the longer ones first; zero energy gives 0."""
    n = F.size(x)
    base, extra = F.floor(n / segments).cast("int"), n % segments
    first = F.lit(segment) * base + F.least(F.lit(segment), extra)
    length = base + F.when(F.lit(segment) < extra, 1).otherwise(0)
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    part = F.when(length > 0, energy(F.slice(x, first + 1, F.greatest(length, F.lit(1))))).otherwise(0.0)
    return F.when(energy(x) == 0, 0.0).otherwise(F.try_divide(part, energy(x)))


def looks_symmetric(x: Column, r: float = 0.95) -> Column:
    return F.abs(mean(x) - quantile(x, 0.5)) < r * (F.array_max(x) - F.array_min(x))


def change_variance(x: Column, low: float = 0.0, high: float = 0.8, absolute: bool = True) -> Column:
    """Variance of steps between neighbours that both lie between two quantiles; none gives 0."""
    def steps(q: Column) -> Column:
        n = F.size(x)
        inside = lambda v: (v >= q["a"]) & (v <= q["b"])
        pairs = F.zip_with(
            F.slice(x, 1, F.greatest(n - 1, F.lit(1))), F.slice(x, 2, F.greatest(n - 1, F.lit(1))),
            lambda v, w: F.when(inside(v) & inside(w), F.abs(w - v) if absolute else w - v),
        )
        return F.filter(pairs, lambda d: d.isNotNull())

    limits = F.struct(quantile(x, low).alias("a"), quantile(x, high).alias("b"))
    return F.coalesce(variance(let(limits, steps)), F.lit(0.0))

"""Statistics over rows before and after, per run. NULLs are skipped; deviations are of the population."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from spokeflow.functions.arrays import quantile

TRAIL = 200

_STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count,
}


def frame(partition: Sequence[str], order: Sequence[str], before: int, after: int) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(-before, after)


def running(x: Column, kind: str, partition: Sequence[str], order: Sequence[str], before: int, after: int = 0) -> Column:
    """A statistic over `before` rows back to `after` rows ahead, cut at the ends of a run."""
    if before < after:
        raise ValueError("a running statistic needs at least as many rows before as after")
    w = frame(partition, order, before, after)
    if kind == "median":  # no frame may be given to it: the frame's values are collected, before + after + 1 at most
        return quantile(F.collect_list(x).over(w), 0.5)
    return _STATISTICS[kind](x).over(w)


def trailing(x: Column, kind: str, partition: Sequence[str], order: Sequence[str], rows: int = TRAIL) -> Column:
    return running(x, kind, partition, order, rows)


def trailing_slope(y: Column, partition: Sequence[str], order: Sequence[str], rows: int = TRAIL) -> Column:
    """Least-squares slope against the row number over the trailing rows."""
    w = frame(partition, order, rows, 0)
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("double")
    x = F.when(y.isNotNull(), n)
    count, sx, sy = F.count(y).over(w), F.sum(x).over(w), F.sum(y).over(w)
    return F.try_divide(count * F.sum(x * y).over(w) - sx * sy, count * F.sum(x * x).over(w) - sx * sx)


def circular_running(angle: Column, partition: Sequence[str], order: Sequence[str], before: int, after: int) -> Column:
    """The running mean of an angle in degrees, by its sine and cosine."""
    w = frame(partition, order, before, after)
    rad = F.radians(angle)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)).over(w), F.avg(F.cos(rad)).over(w))), F.lit(360.0))


def gaussian(
    x: Column, sigma: float, partition: Sequence[str], order: Sequence[str], truncate: float = 4.0, number: Column | None = None, count: Column | None = None,
) -> Column:
    """Gaussian smoothing; beyond an end the run is reflected about its edge (d c b a | a b c d).

    `number` and `count` are a row's number from 0 and the rows of its run, where the partition is a piece of a run that
    holds `reach(sigma)` rows before and after its own.
    """
    near_by = reach(sigma, truncate)
    weight = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-near_by, near_by + 1)]
    total = sum(weight)
    own = Window.partitionBy(*partition).orderBy(*order)
    whole = Window.partitionBy(*partition)
    n = F.count(F.lit(1)).over(whole) if count is None else count
    i = F.row_number().over(own) - 1 if number is None else number
    near = F.collect_list(x).over(own.rowsBetween(-near_by, near_by))
    first = F.greatest(i - near_by, F.lit(0))

    def at(k: int) -> Column:
        j = F.pmod(i + k, 2 * n)
        j = F.when(j >= n, 2 * n - 1 - j).otherwise(j)
        return F.try_element_at(near, (j - first + 1).cast("int"))

    return reduce(lambda a, b: a + b, [at(k) * (w / total) for k, w in zip(range(-near_by, near_by + 1), weight)])


def reach(sigma: float, truncate: float = 4.0) -> int:
    """Rows that Gaussian smoothing looks back and ahead."""
    return int(truncate * sigma + 0.5)

"""Putting streams with clocks of their own on one grid of equal time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.functions.scalars import BIN_S, mean_angle, nan_to_null


def bin_number(ts: Column, start: Column, width: float) -> Column:
    """The bin [start + i * width, start + (i + 1) * width) that holds ts, by the edges as they are computed."""
    i = F.floor((ts - start) / width)
    i = F.when(ts < start + i * width, i - 1).when(ts >= start + (i + 1) * width, i + 1).otherwise(i)
    return i.cast("bigint")


def grid(df: DataFrame, ts: str, run: Sequence[str], width: float = BIN_S) -> DataFrame:
    """Per run its `start` and `bins`: edges lie a width apart from the first time on and before the last one.

    Bins are what lies between edges, so the rest after the last edge is no bin.
    """
    span = df.groupBy(*run).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"))
    return span.select(*run, "start", F.greatest(F.ceil((F.col("stop") - F.col("start")) / width) - 1, F.lit(0)).cast("bigint").alias("bins"))


def on_grid(df: DataFrame, edges: DataFrame, ts: str, run: Sequence[str], width: float = BIN_S) -> DataFrame:
    """Rows with their bin on a run's grid; the last bin holds its right edge, later rows are dropped."""
    rows = df.join(edges, list(run)).withColumn("bin", bin_number(F.col(ts), F.col("start"), width))
    last = (F.col("bin") == F.col("bins")) & (F.col(ts) <= F.col("start") + F.col("bins") * width)
    return rows.withColumn("bin", F.when(last, F.col("bins") - 1).otherwise(F.col("bin"))).where("bin >= 0 and bin < bins")


def bin_means(df: DataFrame, run: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*run, "bin").agg(*[F.avg(nan_to_null(F.col(v))).alias(v) for v in values])


def bin_angles(df: DataFrame, run: Sequence[str], angle: str, output: str) -> DataFrame:
    """The circular mean of an angle in degrees per bin."""
    rad = F.radians(nan_to_null(F.col(angle)))
    return df.groupBy(*run, "bin").agg(mean_angle(F.avg(F.sin(rad)), F.avg(F.cos(rad))).alias(output))


def bin_frames(df: DataFrame, run: Sequence[str], frame: str) -> DataFrame:
    """The element-wise mean of frames (array<double>) per bin, with one row per element in the shuffle."""
    cells = df.select(*run, "bin", F.posexplode(frame).alias("at", "x"))
    means = cells.groupBy(*run, "bin", "at").agg(F.avg(nan_to_null(F.col("x"))).alias("x"))
    return means.groupBy(*run, "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(frame))


def bin_rocks(df: DataFrame, run: Sequence[str], rock: str = "rock", depth: str = "rock_depth", onto: DataFrame | None = None) -> DataFrame:
    """A bin is over a rock if any of its rows is, or if one of it and the bin before is; depth is the mean.

    Bins taken in by their neighbour have the smallest depth of the run's rows with the flag 1; in a run without such rows
    none is taken in. `onto` gives the bins that
    count (run.., bin); those without rows are over no rock.
    """
    bins = df.groupBy(*run, "bin").agg(
        F.max(F.when(F.col(rock) > 0, 1).otherwise(0)).alias(rock), F.avg(depth).alias(depth), F.min(F.when(F.col(rock) == 1, F.col(depth))).alias("_first")
    )
    if onto is not None:
        bins = onto.select(*run, "bin").join(bins, [*run, "bin"], "left")
        bins = bins.withColumns({rock: F.coalesce(rock, F.lit(0)), depth: F.coalesce(depth, F.lit(0.0))})
    w = Window.partitionBy(*run).orderBy("bin")
    first = F.min("_first").over(Window.partitionBy(*run))
    half = (F.coalesce(F.lag(rock).over(w), F.col(rock)) + F.col(rock) == 1) & first.isNotNull()
    return bins.select(
        *run, "bin", F.when(half, 1).otherwise(F.col(rock)).alias(rock), F.when(half, first).otherwise(F.col(depth)).alias(depth)
    )


def align(required: Sequence[DataFrame], optional: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Binned streams side by side: a bin needs every required stream, others are NULL where absent.

    All inputs are aggregates on `keys`, so they are partitioned alike and the joins add no shuffle
    of the raw rows.
    """
    out = required[0]
    for df in required[1:]:
        out = out.join(df, list(keys))
    for df in optional:
        out = out.join(df, list(keys), "left")
    return out

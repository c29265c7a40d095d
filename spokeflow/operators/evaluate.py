"""Aggregates that judge predictions and summarise tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.lineage import written
from spokeflow.plans.quantiles import quantiles


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per (label, prediction) and their share of the label's rows."""
    n = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    rows = df.groupBy(label).agg(F.count("*").alias("_all"))
    return n.join(rows, label).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def errors(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mean and deviation of residuals, and accuracy."""
    d = F.col(prediction) - F.col(label)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.stddev_pop(d).alias("spread"), F.avg((d == 0).cast("double")).alias("accuracy")
    )


def binned_residuals(df: DataFrame, label: str, prediction: str, width: float = 0.05, stop: float = 1.1) -> DataFrame:
    """Residuals per bin of the label on [0, stop)."""
    rows = df.where(F.col(label).between(0, stop) & (F.col(label) < stop)).withColumn("bin", F.floor(F.col(label) / width).cast("int"))
    return errors(rows, label, prediction, ["bin"])


def best_class(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Mean score per class over repeats, then the class of the largest, the smaller label on ties."""
    mean = df.groupBy(*keys, label).agg(F.avg(score).alias("score"))
    return mean.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("score"), F.col(label))).alias("best"), F.max("score").alias("score"))


def share_of(df: DataFrame, condition: Column, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(condition.cast("double")).alias("share"), F.count("*").alias("n"))


def medians(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return quantiles(df, by, {"_m": value}, [0.5]).select(*by, F.col("_m")[0].alias("median"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Density per bin; the last bin holds its right edge."""
    width = (high - low) / bins
    i = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(value).between(low, high)).groupBy(*by, i.alias("bin")).agg(F.count("*").alias("n"))
    total = rows.groupBy(*by).agg(F.sum("n").alias("_all"))
    out = rows.join(total, list(by)) if by else rows.join(total, F.lit(True))
    return out.withColumn("density", F.col("n") / F.col("_all") / width).drop("_all")


BUCKETS = 64  # of a bandwidth
MOMENTS = 6
REACH = 9.0  # bandwidths beyond which a kernel is under 3e-18 of its peak


def kernel_density(df: DataFrame, value: str, points: Sequence[float], bandwidth: float = 0.5) -> DataFrame:
    """Gaussian kernel density (x, density) at given points.

    Rows are summed to buckets of a 64th of a bandwidth, as their number and the moments of their distances from its middle, so what is compared
    with the points grows with the range of the values and not with the rows. A kernel is expanded about the middle in Hermite
    polynomials; distances are at most 1/128 of a bandwidth, so what six terms leave out is below 1e-14 of a kernel. A bucket
    meets the points within `REACH` bandwidths.
    """
    spark = df.sparkSession
    wide = bandwidth / BUCKETS
    rows = df.select(F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.withColumn("_b", F.floor(F.col("_v") / wide))
    d = (F.col("_v") - (F.col("_b") + 0.5) * wide) / bandwidth
    buckets = rows.groupBy("_b").agg(*[F.sum(F.pow(d, F.lit(k)) / math.factorial(k)).alias(f"_m{k}") for k in range(MOMENTS + 1)])
    buckets = written(buckets.withColumn("_c", (F.col("_b") + 0.5) * wide))
    cell = lambda c: F.floor(c / (REACH * bandwidth))
    at = spark.createDataFrame([(float(p),) for p in points], "x double").withColumn("_cell", cell(F.col("x")))
    near = buckets.withColumn("_cell", F.explode(F.array(*[cell(F.col("_c")) + o for o in (-1, 0, 1)]))).join(F.broadcast(at), "_cell")
    u = (F.col("x") - F.col("_c")) / bandwidth
    hermite = [F.lit(1.0), F.col("_u")]
    for k in range(1, MOMENTS):
        hermite.append(F.col("_u") * hermite[k] - k * hermite[k - 1])
    share = F.exp(-0.5 * F.col("_u") * F.col("_u")) * sum(h * F.col(f"_m{k}") for k, h in enumerate(hermite))
    sums = near.withColumn("_u", u).where(F.abs("_u") <= REACH).groupBy("x").agg(F.sum(share).alias("_s"))
    total = buckets.agg(F.sum("_m0").alias("_n"))
    norm = 1 / (bandwidth * math.sqrt(2 * math.pi))
    out = at.select("x").join(sums, "x", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("x", F.when(F.col("_n") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("_n") * norm).alias("density"))


def top(df: DataFrame, score: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows of the largest score."""
    return df.orderBy(F.desc(score), *ties).limit(n)


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in `other`: the complement of a membership mask."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def sweep(spark, **grid: Sequence) -> DataFrame:
    """All combinations of parameter values."""
    out = spark.range(1).select()
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


#: How the programs under test print what a sweep records.
PRINTED = {
    "runtime": r"Parallel DBSCAN \(init, local computation, and merging\) took (\d+\.\d+)", "clusters": r"Total number of clusters (\d+)",
    "samples": r"Test samples: (\d+)", "predict_time": r"Predict took: (\d+\.\d+)", "error_rate": r"the total error rate is:(\d+\.\d+)",
}


def run_results(df: DataFrame, output: str) -> DataFrame:
    """Adds the numbers that a run printed, NULL where absent; runtime of a forest is its prediction time a sample, and accuracy one less its error rate."""
    found = {k: F.try_to_number(F.nullif(F.regexp_extract(output, p, 1), F.lit("")), F.lit("9999999999.999999999")).cast("double") for k, p in PRINTED.items()}
    out = df.withColumns(found)
    runtime = F.coalesce("runtime", F.try_divide("predict_time", "samples"))
    return out.withColumns({"runtime": runtime, "accuracy": 1 - F.col("error_rate"), "clusters": F.col("clusters").cast("bigint")}).drop("samples", "predict_time", "error_rate")

"""Exact quantiles of groups of any size.

A percentile aggregate holds all distinct values of a group in one buffer. That is right for groups that fit; where a group has more rows
than `most`, which a count finds out first, values are ranked instead: they are dealt to tasks by ranges of (group, value), each range
learns from the counts of those before it where it begins, and the two rows beside each quantile's place are picked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.spread import numbered

MOST = 1_000_000  # rows of a group that one buffer may hold


def quantiles(df: DataFrame, by: Sequence[str], columns: dict[str, str], shares: Sequence[float], most: int = MOST) -> DataFrame:
    """One row a group: by, and for each output the array of quantiles of its column, interpolated between ranks. Nulls are left out."""
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return df.groupBy(*by).agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in shares])).alias(o) for o, c in columns.items()])
    out = df.select(*by).distinct()
    for output, column in columns.items():
        found = ranked(df, by, column, shares, output).withColumnsRenamed({c: f"_q{i}" for i, c in enumerate(by)})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q{i}")) for i, c in enumerate(by)], F.lit(True))
        out = out.join(found, same, "left").drop(*[f"_q{i}" for i in range(len(by))]) if by else found
    return out


def ranked(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], output: str) -> DataFrame:
    """`quantiles` of one column by ranks, whatever the size of a group."""
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    rows = rows.withColumn("_at", F.spark_partition_id())  # equal values are interchangeable and may be dealt to several ranges
    rows = numbered(rows, by, ["_v", "_at"]).drop("_at") if by else numbered(rows.withColumn("_all", F.lit(0)), ["_all"], ["_v", "_at"]).drop("_at", "_all")
    places = [F.lit(float(p)) * (F.col("_n") - 1) for p in shares]
    wanted = reduce(lambda a, b: a | b, [(F.col("_rn") == F.floor(p)) | (F.col("_rn") == F.ceil(p)) for p in places])
    cells = []
    for p in places:
        low = F.max(F.when(F.col("_rn") == F.floor(p), F.col("_v")))
        high = F.max(F.when(F.col("_rn") == F.ceil(p), F.col("_v")))
        part = F.max(p - F.floor(p))
        cells.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high))
    return rows.where(wanted).groupBy(*by).agg(F.array(*cells).alias(output))

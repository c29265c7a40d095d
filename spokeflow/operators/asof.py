"""Joins in time order, as one union and one pass in time order instead of a range join. A key with rows of any number is
taken by ranges of time, each of which hands its last row on to the next."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.spread import filled


def _stacked(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str) -> DataFrame:
    l = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    r = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*right.columns).alias("_r"))
    return l.unionByName(r, allowMissingColumns=True)


def backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str], wrap: bool = False,
) -> DataFrame:
    """The latest row of `right` at or before each row of `left`, of several at one time the largest by its columns; with
    `wrap`, rows before the first get the last."""
    rows = _stacked(left, right, by, left_ts, right_ts)
    # a right row at the same time sorts before a left one
    rows = filled(rows, by, ["_ts", "_side", "_r"], _f=(F.col("_r"), False)).where("_side = 1")
    if wrap:
        names = [f"_of{i}" for i in range(len(by))]
        latest = right.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)]).agg(F.max(F.struct(F.col(right_ts).alias("_ts"), F.struct(*right.columns).alias("_r"))).alias("_last"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(by, names)])
        rows = rows.join(latest, same, "left").withColumn("_f", F.coalesce("_f", "_last._r"))
    return rows.select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in columns])


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str]) -> DataFrame:
    """The row of `right` nearest in time to each row of `left`; the earlier one on ties, of several at one time the largest
    by its columns if they are earlier and the smallest if they are later."""
    rows = _stacked(left, right, by, left_ts, right_ts)
    stamped = F.when(F.col("_r").isNotNull(), F.struct("_ts", "_r"))
    rows = filled(rows, by, ["_ts", "_side", "_r"], _b=(stamped, False), _a=(stamped, True)).where("_side = 1")
    back, ahead = F.col("_ts") - F.col("_b._ts"), F.col("_a._ts") - F.col("_ts")
    take = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("_f", take).select("_l.*", *[F.col(f"_f._r.{c}").alias(c) for c in columns])


def valid_from(df: DataFrame, versions: DataFrame, date: str, start: str, columns: Sequence[str], base: Sequence = ()) -> DataFrame:
    """The newest version whose start is not after a row's date; rows before all versions get `base` values.

    Versions are a handful of rows (calibrations), so up to 1,000 become literals; more are joined in time order.
    """
    rows = versions.orderBy(start).limit(1001).collect()
    if len(rows) > 1000:
        return _valid_from_many(df, versions, date, start, columns, base)
    out = df
    for i, c in enumerate(columns):
        found = F.lit(base[i]) if base else F.lit(None)
        for r in rows:  # later versions override earlier ones
            found = F.when(F.col(date) >= F.lit(r[start]), F.lit(r[c])).otherwise(found)
        out = out.withColumn(c, found)
    return out


def _valid_from_many(df: DataFrame, versions: DataFrame, date: str, start: str, columns: Sequence[str], base: Sequence) -> DataFrame:
    """`valid_from` for any number of versions: per distinct date of `df` its version, joined back to the rows."""
    dates = df.select(F.lit(0).alias("_k"), F.col(date).alias("_d")).where("_d is not null").distinct()
    v = versions.select(F.lit(0).alias("_k"), F.col(start).alias("_s"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    names = [f"_v_{c}" for c in columns]
    found = backward(dates, v.withColumn("_has", F.lit(True)), ["_k"], "_d", "_s", [*names, "_has"])
    out = df.join(found.select("_d", "_has", *names), df[date] == F.col("_d"), "left")
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.when(F.col("_has"), F.col(f"_v_{c}")).otherwise(F.lit(base[i]) if base else F.lit(None)))
    return out.drop("_d", "_has", *names)


def nearest_value(df: DataFrame, keys: Sequence[str], value: str, targets: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """Per key and target the row whose value is nearest; the smaller value on ties, then the smallest row by `columns`."""
    rows = df.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    far = F.struct(F.abs(F.col(value) - F.col("target")), F.col(value), *columns)
    return rows.groupBy(*keys, "target").agg(*[F.min_by(c, far).alias(c) for c in columns])

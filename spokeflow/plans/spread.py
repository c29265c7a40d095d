"""Windows over groups of any size: a long group is cut into pieces that carry the rows around them.

A window over a run sorts the run in one task. Where frames reach a known number of rows back and ahead, a run can
be cut into pieces of `PIECE` rows, each with copies of that many rows before and after it: every row then finds its
whole frame in its own piece, and a run of any length is sorted by many tasks. Where a frame is all that came before
(the last value, a running sum), a run is cut into ranges that hand on what the next ones need.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.plans.lineage import written

PIECE = 1 << 14


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds _rn, a row's number from 0 in its group, and _n, the group's rows.

    Rows are dealt to tasks by ranges of (by, order) and numbered in each; what a group has in earlier ranges is
    added from a table of one row a group and range. `order` should tell all rows of a group apart.
    """
    rows = _in_ranges(df, by, order)
    names = [f"_by{i}" for i in range(len(by))]
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    rows = _over_ranges(rows, by, {"_low": F.min("_at"), "_c": F.count("*")}, {
        "_before": F.sum("_c").over(group.orderBy("_of")) - F.col("_c"), "_n": F.sum("_c").over(group), "_start": F.col("_low"),
    })
    return rows.withColumn("_rn", F.col("_at") - F.col("_start") + F.col("_before")).drop("_at", "_range", "_start", "_before")


def _in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges of (by, order), written, with _range and their place _at in the order of all."""
    keys = [F.col(c) for c in (*by, *order)]
    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = written(rows.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_range", F.shiftright("_at", 33))


def _over_ranges(rows: DataFrame, by: Sequence[str], each: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Adds what ranges before or after a row's own hand on: `each` is taken per group and range, `carried` over those in _of's order."""
    names = [f"_by{i}" for i in range(len(by))]
    held = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_range").alias("_of")).agg(*[v.alias(k) for k, v in each.items()])
    held = held.withColumns(carried).drop(*each)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], F.col("_range") == F.col("_of"))
    return rows.join(held, same).drop("_of", *names)


def filled(df: DataFrame, by: Sequence[str], order: Sequence[str], **outputs: tuple[Column, bool]) -> DataFrame:
    """Adds for each output the last value of an expression that isn't NULL at or before a row or, with True, the first at or after it.

    A group of any length is taken by ranges: each hands on its own last and first value.
    """
    rows = _in_ranges(df, by, order)
    names = [f"_by{i}" for i in range(len(by))]
    group = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("_of")
    own = Window.partitionBy(*by, "_range").orderBy("_at")
    each, carried, out = {}, {}, {}
    for k, (value, ahead) in outputs.items():
        at = F.when(value.isNotNull(), F.col("_at"))
        each[f"_e_{k}"] = F.min_by(value, at) if ahead else F.max_by(value, at)
        frame = group.rowsBetween(1, Window.unboundedFollowing) if ahead else group.rowsBetween(Window.unboundedPreceding, -1)
        carried[f"_c_{k}"] = (F.first if ahead else F.last)(F.col(f"_e_{k}"), ignorenulls=True).over(frame)
        here = (F.first if ahead else F.last)(value, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing) if ahead else own.rowsBetween(Window.unboundedPreceding, 0))
        out[k] = F.coalesce(here, F.col(f"_c_{k}"))
    return _over_ranges(rows, by, each, carried).withColumns(out).drop("_at", "_range", *carried)


def summed(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, output: str) -> DataFrame:
    """Adds the running sum of a value, a group of any length taken by ranges that hand on their sums."""
    rows = _in_ranges(df.withColumn("_v", value), by, order)
    names = [f"_by{i}" for i in range(len(by))]
    group = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    rows = _over_ranges(rows, by, {"_s": F.sum("_v")}, {"_before": F.coalesce(F.sum("_s").over(group), F.lit(0.0))})
    own = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(output, F.col("_before") + F.sum("_v").over(own)).drop("_at", "_range", "_before", "_v")


def in_pieces(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int = 0, rows: int = PIECE) -> DataFrame:
    """`numbered` rows with _piece, and _own: false for copies that only stand around a piece.

    Windows go over (by, _piece) in the order of _rn; of their results only rows with _own count.
    """
    size = max(rows, before, after)
    home = F.floor(F.col("_rn") / size)
    place = F.col("_rn") % size
    pieces = F.array_compact(F.array(
        home, F.when((place >= size - before) & (home < F.floor((F.col("_n") - 1) / size)), home + 1), F.when((place < after) & (home > 0), home - 1)
    ))
    out = numbered(df, by, order).withColumn("_home", home).withColumn("_piece", F.explode(pieces))
    return out.withColumn("_own", F.col("_piece") == F.col("_home")).drop("_home")


def owned(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of the pieces, without what `in_pieces` added but for what is to be kept of it."""
    return df.where("_own").drop(*[c for c in ("_own", "_piece", "_rn", "_n") if c not in keep])

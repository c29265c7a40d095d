"""Row filters of the cleaning steps. Each adds or applies a boolean; windows later run on the rows that stay."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.functions.windows import running
from spokeflow.operators.turning import turning_spans
from spokeflow.plans.quantiles import quantiles
from spokeflow.plans.spread import in_pieces, numbered, owned


def with_run_aggregates(df: DataFrame, run: Sequence[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of a row's run: one row a run, combined before the shuffle, joined back to the rows.

    Unlike a window over the run it never sorts a run in one task, and adaptive execution splits a run that is hot.
    """
    per = df.groupBy(*[F.col(c).alias(f"_run_{c}") for c in run]).agg(*[v.alias(k) for k, v in aggregates.items()])
    if not run:
        return df.crossJoin(F.broadcast(per))  # one row
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_run_{c}")) for c in run])
    return df.join(per, same).drop(*[f"_run_{c}" for c in run])


def with_run_quantiles(df: DataFrame, run: Sequence[str], columns: dict[str, str], shares: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Adds quantiles of a row's run, one array for each output; runs may have any number of rows."""
    per = quantiles(df, run, columns, shares)
    if not run:
        return df.crossJoin(F.broadcast(per))  # one row
    per = per.withColumnsRenamed({c: f"_run_{c}" for c in run})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_run_{c}")) for c in run])
    return df.join(per, same).drop(*[f"_run_{c}" for c in run])


def iqr_inlier(df: DataFrame, x: str, run: Sequence[str], factor: float, output: str = "inlier") -> DataFrame:
    """True strictly inside q1 - factor * iqr and q3 + factor * iqr of a run."""
    rows = with_run_quantiles(df, run, {"_q": x})
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return rows.withColumn(output, (F.col(x) > q1 - factor * (q3 - q1)) & (F.col(x) < q3 + factor * (q3 - q1))).drop("_q")


def clean_slip(df: DataFrame, x: str, run: Sequence[str], order: Sequence[str], output: str = "clean") -> DataFrame:
    """Inliers both by value and by running deviation; runs of ten rows or fewer have none. Long runs are cut into pieces."""
    rows = in_pieces(df, run, order, 10, 10)
    rows = owned(rows.withColumn("_sd", running(F.col(x), "std", [*run, "_piece"], ["_rn"], 10, 10)), ["_n"])
    rows = with_run_quantiles(rows, run, {"_qs": "_sd", "_qx": x})

    def inside(c: str, q: str, factor: float) -> Column:
        q1, q3 = F.col(q)[0], F.col(q)[1]
        return (F.col(c) > q1 - factor * (q3 - q1)) & (F.col(c) < q3 + factor * (q3 - q1))

    ok = inside("_sd", "_qs", 5.0) & inside(x, "_qx", 3.0) & (F.col("_n") > 10)
    return rows.withColumn(output, ok).drop("_sd", "_qs", "_qx", "_n")


def moving(df: DataFrame, current: str, run: Sequence[str], angle: str | None = None, order: str | None = None) -> DataFrame:
    """Rows with a current. A run without any keeps the rows between its first start and first stop by its angle, if one is named."""
    on = F.coalesce(F.nanvl(F.col(current), F.lit(0.0)), F.lit(0.0)) != 0
    rows = with_run_aggregates(df.withColumn("_on", on), run, _some=F.bool_or("_on"))
    if angle is None:
        return rows.where("_on or not _some").drop("_on", "_some")
    spans = turning_spans(rows.where("not _some"), angle, run, order)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_span_{c}")) for c in run])
    rows = rows.join(spans.withColumnsRenamed({c: f"_span_{c}" for c in run}), same, "left")
    kept = F.when(F.col("_some"), F.col("_on")).otherwise((F.col(order) >= F.col("_first")) & (F.col(order) < F.col("_stop")))
    return rows.where(kept).drop("_on", "_some", "_first", "_stop", *[f"_span_{c}" for c in run])


def burn_in(df: DataFrame, run: Sequence[str], order: Sequence[str], low: int) -> DataFrame:
    """Rows from number `low` on, or the last row of a run that is no longer; adds `t`, from 0. A run is numbered by ranges of `order`."""
    rows = numbered(df, run, order).withColumn("t", F.col("_rn").cast("int"))
    return rows.where(F.col("_rn") >= F.least(F.lit(low), F.col("_n") - 1)).drop("_rn", "_n")


def finite_rows(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Rows whose features are all finite, and the label too."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.where(~reduce(lambda a, b: a | b, [bad(c) for c in [*features, *([label] if label else [])]]))


def trainable_rows(df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """`finite_rows`, and of a label with over `most` values only those that `clean_slip` keeps over the whole table in `order`.

    The outliers are found among all rows, those with missing features too.
    """
    if df.select(label).distinct().limit(most + 1).count() > most:
        df = clean_slip(df, label, [], order, "_inlier").where("_inlier").drop("_inlier")
    return finite_rows(df, features, label)


def in_range(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.where(F.col(column).between(low, high))


#: Name parts that the preset leaves out.
PRESET = ["bbox_area", "moments_hu", "moments_normalized", "weighted_centroid", "weighted_moments_hu", "weighted_moments_normalized"]


def select_features(names: Sequence[str], wanted: Sequence[str] | None = None, exclude: Sequence[str] = (), preset: bool = False) -> list[str]:
    """Feature names by list, or without those that hold an excluded part; the preset takes the place of `exclude`."""
    if wanted is not None:
        return [n for n in names if n in set(wanted)]
    return [n for n in names if not any(p in n for p in (PRESET if preset else exclude))]


def complete_fields(line: Column, count: int, sep: str = "\t") -> Column:
    """Whether a line has exactly `count` fields."""
    return F.size(F.split(line, sep)) == count


def good_flow(df: DataFrame, quality: str = "quality", over: int = 100) -> DataFrame:
    """Optical-flow samples whose quality is over a bound."""
    return df.where(F.col(quality) > over)

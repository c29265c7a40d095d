"""From per-run features to one table for training."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.functions.scalars import ROCKY, encoded, feature_name, override_pattern
from spokeflow.operators.signal import PROPERTIES
from spokeflow.plans.lineage import written

PART = 200_000  # groups that the driver holds at a time


def stacked(runs: Sequence[DataFrame]) -> DataFrame:
    """Runs one below the other by column name; a feature that a run lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def wide(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per feature from (keys, name, value); the names are given, so no pass looks for them."""
    return long.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def long(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(names), "name", "value")


def labelled(df: DataFrame, column: str, codes: dict[str, int], output: str = "label") -> DataFrame:
    return df.withColumn(output, encoded(F.col(column), codes))


def clipped_rock(df: DataFrame, rock: str = "rock") -> DataFrame:
    """More than one rock counts as one."""
    return df.withColumn(rock, F.least(F.col(rock), F.lit(1)))


def with_flat_rows(df: DataFrame, run: Sequence[str], pattern: str = "pattern", rock: str = "rock") -> DataFrame:
    """Rows without a rock in runs over rocks are flat."""
    rocky = F.count_if(F.col(pattern).isin(ROCKY)).over(Window.partitionBy(*run)) > 1
    return df.withColumn(pattern, override_pattern(F.col(pattern), F.col(rock), rocky))


#: Feature families of the published lists.
CONTACT = ["area_ratio", "maxcol_imu_diff", "row_wheel_ratio", "contact_mean", "contact_max", "contact_min", "contact_std", "contact_skew", "contact_kurtosis"]
LAGGED = ["peak_max_std", "peak_min_std", "smness", "peak_max_std_cwt", "wt_jump_max", "wt_jump_mean", "wt_min", "wt_max", "len_max_flat", "n_flat"]
SINK = ["sink_mean", "sink_std", "sink_slope", "sink_diff_angle_mean", "sink_theta_m", "sink_diff_angle_std"]
FREQUENCIES = [10550.1, 947.86, 111.304, 10.0]


def feature_catalogue(lags: Sequence[int] = tuple(range(4, -5, -1)), frequencies: Sequence[float] = tuple(FREQUENCIES)) -> dict[str, list[str]]:
    """Feature names by family, as models and lists name them."""
    subsets, parts = ["all", "grouser", "nongrouser"], ["grouser", "nongrouser"]
    return {
        "contact": [feature_name(f, k) for f in CONTACT for k in subsets],
        "lagged": [feature_name(f, k) for f in LAGGED for k in subsets] + ["npix_max_diff", "npix_min_diff"],
        "unwrap": [feature_name(f, k, l) for f in ("unwrap_mean", "unwrap_std") for k in parts for l in lags],
        "image": [feature_name(f, k, l, 1) for f in PROPERTIES for k in parts for l in lags],
        "sink": list(SINK),
        "hydration": [f"{f}_{x}" for f in ("amplitude", "phase") for x in frequencies] + ["rot_angle"],
    }


def category(name: str) -> str | None:
    """The family of a feature's name."""
    return next((c for c, names in feature_catalogue().items() if name in names), None)


def group_folds(df: DataFrame, group: str, folds: int = 10) -> DataFrame:
    """(group, fold): groups, largest first, each go to the fold that holds the fewest rows so far.

    Group sizes are aggregated in Spark. The greedy step is one after the other by nature: it runs on the driver over groups,
    which are runs, a part at a time, and hands them back in parts of PART.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group)
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, fold int"
    held, rows, parts = [0] * folds, [], []
    for g, n in sizes.toLocalIterator():
        i = min(range(folds), key=lambda f: (held[f], f))
        held[i] += n
        rows.append((g, i))
        if len(rows) == PART:
            parts.append(written(df.sparkSession.createDataFrame(rows, schema)))
            rows = []
    return reduce(lambda a, b: a.unionByName(b), [*parts, df.sparkSession.createDataFrame(rows, schema)])


def aligned(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The features a model was fitted on, in its order; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    return df.select(*names)

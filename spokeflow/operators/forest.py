"""CART forests with majority-share leaves, grown one tree per Spark task and applied in Arrow batches.

A node looks at a random choice of features; a split lies midway between two neighbouring values that are at
least GAP apart and sends values below it left. Classification gains by Gini impurity, regression by variance. A
leaf predicts its majority class with that class's share (the first class on ties), or its mean. A forest sums
the shares given to each class and takes the largest sum, the first on ties; regression averages. This vote
differs from averaging whole class distributions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = 1e-6


@dataclass
class Tree:
    """Nodes in preorder; feature -1 marks a leaf; value is a class position or a mean, share its weight."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    share: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not inner.size:
                return at
            n = at[inner]
            low = x[inner, f[inner]] < self.threshold[n]
            at[inner] = np.where(low, self.left[n], self.right[n])


def _best_split(x: np.ndarray, y: np.ndarray, classes: int, least: int) -> tuple[float, float]:
    """Largest gain over one feature and its threshold; classes 0 means regression."""
    order = np.argsort(x, kind="stable")
    s, n = x[order], len(x)
    ok = s[1:] - s[:-1] >= GAP
    left = np.arange(1, n)
    ok &= (left >= least) & (n - left >= least)
    if not ok.any():
        return 0.0, 0.0
    if classes:
        hot = np.zeros((n, classes))
        hot[np.arange(n), y[order].astype(int)] = 1
        below = hot.cumsum(0)
        total = below[-1]
        a, b = below[:-1], total - below[:-1]
        gain = (a * a).sum(1) / left + (b * b).sum(1) / (n - left) - (total * total).sum() / n
    else:
        below = y[order].cumsum()
        a, b = below[:-1], below[-1] - below[:-1]
        gain = a * a / left + b * b / (n - left) - below[-1] ** 2 / n
    gain = np.where(ok, gain, -1.0)
    i = int(gain.argmax())
    return float(gain[i]), float((s[i] + s[i + 1]) / 2)


def feature_count(option: str, features: int) -> int:
    """Features that a node looks at: `auto` and `sqrt` the root of all, `log2` their logarithm, `none` all."""
    count = {"auto": np.sqrt, "sqrt": np.sqrt, "log2": np.log2, "none": float}[option.lower()](features)
    return max(1, int(count))


def grow(
    x: np.ndarray, y: np.ndarray, classes: int, max_depth: int = 10, min_leaf: int = 1,
    max_features: int | str | None = None, seed: int = 0, bootstrap: bool = True,
) -> Tree:
    """One tree; `classes` 0 grows a regression tree. `max_features` are looked at in a node: a number, or an option of `feature_count`."""
    rng = np.random.default_rng(seed)
    if bootstrap:
        pick = rng.integers(0, len(x), len(x))
        x, y = x[pick], y[pick]
    some = max_features if isinstance(max_features, int) and max_features else feature_count(max_features or "auto", x.shape[1])
    nodes: list[list[float]] = []

    def leaf(rows: np.ndarray) -> list[float]:
        if not classes:
            return [-1, 0, -1, -1, float(y[rows].mean()), 1.0]
        count = np.bincount(y[rows].astype(int), minlength=classes)
        return [-1, 0, -1, -1, int(count.argmax()), float(count.max() / len(rows))]

    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append(leaf(rows))
        if parent >= 0:
            nodes[parent][2 + side] = me
        if depth >= max_depth or len(rows) < 2 * min_leaf or (y[rows] == y[rows[0]]).all():
            continue
        best = (1e-12, -1, 0.0)
        for f in rng.permutation(x.shape[1])[:some]:
            gain, cut = _best_split(x[rows, f], y[rows], classes, min_leaf)
            if gain > best[0]:
                best = (gain, int(f), cut)
        if best[1] < 0:
            continue
        low = x[rows, best[1]] < best[2]
        nodes[me][0], nodes[me][1] = best[1], best[2]
        stack += [(rows[~low], depth + 1, me, 1), (rows[low], depth + 1, me, 0)]
    c = np.array(nodes, float).T
    return Tree(c[0].astype(int), c[1], c[2].astype(int), c[3].astype(int), c[4], c[5])


def importances(trees: list[Tree], features: int) -> np.ndarray:
    """Share of splits that use each feature."""
    used = np.bincount(np.concatenate([t.feature[t.feature >= 0] for t in trees] or [np.zeros(0, int)]), minlength=features)
    return used / max(1, used.sum())


def votes(trees: list[Tree], x: np.ndarray, classes: int) -> np.ndarray:
    """Summed leaf shares by class."""
    out = np.zeros((len(x), classes))
    for t in trees:
        at = t.leaves(x)
        out[np.arange(len(x)), t.value[at].astype(int)] += t.share[at]
    return out


def predict(trees: list[Tree], x: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return votes(trees, x, classes).argmax(1)
    return np.mean([t.value[t.leaves(x)] for t in trees], axis=0)


_NODE = "tree int, node int, feature int, threshold double, left int, right int, value double, share double"


def fit_forest(
    df: DataFrame, features: list[str], label: str, classes: int, trees: int = 20, seed: int = 0, sample: int = 50_000, **options
) -> DataFrame:
    """The node table of a forest: one task grows each tree.

    The training rows travel to every task, so they are bounded: at most `sample` rows, chosen by a
    hash of their values.
    """
    data = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double")).dropna()
    rows = data.count()
    h = F.xxhash64(*data.columns)
    if rows > sample:  # a share of the hash's range that holds some more than that, so only those are sorted
        low = -(1 << 63)
        data = data.where(h < F.lit(min((1 << 63) - 1, low + int((1 << 64) * min(1.0, 1.1 * sample / rows + 1000 / rows)))))
    data = data.orderBy(h, *data.columns).limit(sample).toPandas()
    x, y = data[features].to_numpy(float), data[label].to_numpy(float)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((x, y))

    def run(batches):
        for pdf in batches:
            for t in pdf["tree"]:
                xs, ys = held.value
                g = grow(xs, ys, classes, seed=seed * 100_003 + int(t), **options)
                yield pd.DataFrame({
                    "tree": int(t), "node": np.arange(len(g.feature)), "feature": g.feature, "threshold": g.threshold,
                    "left": g.left, "right": g.right, "value": g.value, "share": g.share,
                })

    numbers = spark.range(0, trees, 1, min(trees, spark.sparkContext.defaultParallelism)).select(F.col("id").cast("int").alias("tree"))
    return numbers.mapInPandas(run, _NODE)


def load_trees(nodes: DataFrame) -> list[Tree]:
    """Trees of a node table, whose size the forest's parameters bound."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    return [Tree(*(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "share"))) for _, g in table.groupby("tree")]


def read_forest(spark: SparkSession, path: str) -> list[Tree]:
    """Trees of a node table that `writers.write_forest` wrote."""
    return load_trees(spark.read.parquet(path))


def apply_forest(df: DataFrame, trees: list[Tree], features: list[str], classes: int, output: str = "prediction") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(predict(held.value, np.column_stack([c.to_numpy(float) for c in columns]), classes).astype(float))

    columns: list[Column] = [F.col(c).cast("double") for c in features]
    return df.withColumn(output, score(*columns))

"""Trees grown level by level over all rows, and boosting of several classes at once.

No row leaves its task: a level is one pass in which each task sums, for every open node, the rows of each bin of each feature (their number and
the sums of the targets, or of the classes), and the sums of all tasks are added by groups. The best cut of a node is read off its
bins, and the nodes, of all branches and all trees at once, are what reaches the driver. Bins are a feature's values where it has few, and
quantiles otherwise; where they are its values, cuts are those of a sort: midway between two values that the node holds. With `exact` a
feature of many values has no bins: its sums by value are added up in order by many tasks, and of each node the best cut comes back.

`boosted` fits one tree for each class and round on the softmax gradient, with a Newton step in each leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from spokeflow.operators.boxes import _vectors
from spokeflow.operators.forest import GAP, Tree, feature_count
from spokeflow.plans.lineage import bounded_batches, written
from spokeflow.plans.spread import _in_ranges, _over_ranges

BINS = 1024
CELLS = 4 << 20  # sums that a task holds in one pass; more open nodes than fit take further passes


@dataclass
class Bins:
    """Of each feature the upper ends of its bins, and whether they are all its values."""

    edges: list[np.ndarray]
    exact: list[bool]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.minimum(np.searchsorted(e, x[:, f]), len(e) - 1) for f, e in enumerate(self.edges)])

    def cut(self, f: int, a: int, b: int) -> float:
        """Between bin a and the next bin b that holds rows: what is below it goes left."""
        e = self.edges[f]
        if self.exact[f]:
            return float((e[a] + e[b]) / 2)
        return float(np.nextafter(e[a], np.inf) if b == a + 1 else (e[a] + e[b - 1]) / 2)


def bins(rows: DataFrame, most: int = BINS, rough: bool = True) -> Bins:
    """From one row a feature: its values if they are at most `most`, else so many quantiles or, unless `rough`, a single bin."""
    cells = rows.select(F.posexplode("x").alias("i", "v"))
    few = cells.groupBy("i").agg(F.approx_count_distinct("v", 0.02).alias("n"))
    shares = [(k + 1) / most for k in range(most)]
    exact = cells.join(F.broadcast(few.where(F.col("n") <= 0.9 * most)), "i").groupBy("i").agg(F.sort_array(F.collect_set("v")).alias("e"), F.lit(True).alias("exact"))
    many = few.where(F.col("n") > 0.9 * most)
    if rough:
        others = cells.join(F.broadcast(many), "i").groupBy("i").agg(F.percentile_approx("v", shares, 20 * most).alias("e"), F.lit(False).alias("exact"))
    else:
        others = many.select("i", F.array(F.lit(0.0)).alias("e"), F.lit(False).alias("exact"))
    found = sorted(exact.unionByName(others).collect(), key=lambda r: r.i)
    return Bins([np.unique(np.array(r.e, float)) for r in found], [r.exact for r in found])


class _Growing:
    """Trees whose nodes are added level by level."""

    def __init__(self, trees: int):
        self.nodes: list[list[list[float]]] = [[[-1, 0.0, -1, -1, 0.0, 1.0]] for _ in range(trees)]

    def tree(self, t: int) -> Tree:
        c = np.array(self.nodes[t], float).T
        return Tree(c[0].astype(int), c[1], c[2].astype(int), c[3].astype(int), c[4], c[5])

    def trees(self) -> list[Tree]:
        return [self.tree(t) for t in range(len(self.nodes))]


def _sums(rows: DataFrame, trees: list[Tree], open_nodes: list[tuple[int, int]], b: Bins, chosen: np.ndarray, classes: int) -> DataFrame:
    """(o, f, bins): for each open node and feature that it looks at, the bins with their rows and sums, in order."""
    spark = rows.sparkSession
    width, many = len(b.edges), max(len(e) for e in b.edges)
    kinds = classes or 1
    sent = spark.sparkContext.broadcast((trees, open_nodes, b, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, nodes, b, chosen = sent.value
        total = np.zeros((len(nodes), width, many, kinds + (0 if classes else 1)))
        at = [{n: o for o, (t, n) in enumerate(nodes) if t == k} for k in range(len(trees))]
        seen = False
        for batch in batches:
            x, y = _vectors(batch.column(0)), _vectors(batch.column(1))
            w = _vectors(batch.column(2))
            if not len(x):
                continue
            seen, bin_ = True, b.of(x)
            for k, tree in enumerate(trees):
                if not at[k]:
                    continue
                place = np.full(len(tree.feature), -1)
                place[list(at[k])] = list(at[k].values())
                o = place[tree.leaves(x)]
                here = np.flatnonzero((o >= 0) & (w[:, k] > 0))
                flat = (o[here, None] * width + np.arange(width)) * many + bin_[here]
                flat = flat[chosen[o[here]]]
                each = np.repeat(here, chosen[o[here]].sum(1))
                if classes:
                    cell = flat * kinds + y[each, k].astype(int)
                    total += np.bincount(cell, w[each, k], total.size).reshape(total.shape)
                else:
                    total[..., 0] += np.bincount(flat, w[each, k], total[..., 0].size).reshape(total.shape[:-1])
                    total[..., 1] += np.bincount(flat, w[each, k] * y[each, k], total[..., 0].size).reshape(total.shape[:-1])
        if seen:
            o, f, c = np.nonzero(total.any(-1) if classes else total[..., 0] > 0)
            for low in range(0, len(o), 50_000):
                part = slice(low, low + 50_000)
                sums = total[o[part], f[part], c[part]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (o[part], f[part], c[part])] + [lists], names=["o", "f", "c", "s"])

    cells = rows.mapInArrow(run, "o int, f int, c int, s array<double>")
    n = kinds if classes else 2
    added = cells.groupBy("o", "f", "c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s"))
    return added.groupBy("o", "f").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("bins"))  # at most the bins of a feature


def _cuts(sums: DataFrame, b: Bins, classes: int, least: int) -> list:
    """For each open node its sums and the cut of largest gain."""
    sent = sums.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            out = []
            for o, f, cells in zip(*(c.to_pylist() for c in batch.columns)):
                at, s = np.array([c["c"] for c in cells]), np.array([c["s"] for c in cells])
                rows = s.sum(1) if classes else s[:, 0]
                below, left = s.cumsum(0), rows.cumsum()
                all_, n = below[-1], left[-1]
                best = (0.0, 0.0)
                if len(at) > 1:
                    a, z, nl = below[:-1], all_ - below[:-1], left[:-1]
                    if classes:
                        gain = (a * a).sum(1) / nl + (z * z).sum(1) / (n - nl) - (all_ * all_).sum() / n
                    else:
                        gain = a[:, 1] ** 2 / nl + z[:, 1] ** 2 / (n - nl) - all_[1] ** 2 / n
                    e = b.edges[f]
                    ok = (nl >= least) & (n - nl >= least) & ((e[at[1:]] - e[at[:-1]] >= GAP) | (not b.exact[f]))
                    gain = np.where(ok, gain, -1.0)
                    i = int(gain.argmax())
                    if gain[i] > 1e-12:
                        best = (float(gain[i]), b.cut(f, int(at[i]), int(at[i + 1])))
                out.append((o, f, best[0], best[1], all_.tolist()))
            c = list(zip(*out)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], names=["o", "f", "gain", "cut", "s"])

    found = sums.mapInArrow(run, "o int, f int, gain double, cut double, s array<double>")
    return found.groupBy("o").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), "cut", "s")).alias("b")).collect()


def _sorted_cuts(rows: DataFrame, trees: list[Tree], open_nodes: list[tuple[int, int]], chosen: np.ndarray, classes: int, least: int) -> list:
    """The same as `_cuts` of `_sums`, of all values of the features: sums by node, feature and value, added up over ranges of values."""
    sent = rows.sparkSession.sparkContext.broadcast((trees, open_nodes, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, nodes, chosen = sent.value
        at = [{n: o for o, (t, n) in enumerate(nodes) if t == k} for k in range(len(trees))]
        for batch in batches:
            x, y, w = (_vectors(c) for c in batch.columns)
            if not len(x):
                continue
            for k, tree in enumerate(trees):
                if not at[k]:
                    continue
                place = np.full(len(tree.feature), -1)
                place[list(at[k])] = list(at[k].values())
                o = place[tree.leaves(x)]
                here = np.flatnonzero((o >= 0) & (w[:, k] > 0))
                r, f = np.nonzero(chosen[o[here]])
                r = here[r]
                for low in range(0, len(r), 50_000):
                    i, j = r[low : low + 50_000], f[low : low + 50_000]
                    out = [o[i].astype(np.int32), j.astype(np.int32), x[i, j], w[i, k], y[i, k]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["o", "f", "v", "w", "y"])

    cells = rows.select("x", "y", "w").mapInArrow(run, "o int, f int, v double, w double, y double")
    w, y = F.col("w"), F.col("y")
    sums = [F.sum(F.when(y == k, w).otherwise(0.0)) for k in range(classes)] if classes else [F.sum(w), F.sum(w * y)]
    ks = range(len(sums))
    held = _in_ranges(cells.groupBy("o", "f", "v").agg(*[c.alias(f"_k{k}") for k, c in enumerate(sums)]), ["o", "f"], ["v"])
    group = Window.partitionBy("_by0", "_by1")
    before = group.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    each = {f"_e{k}": F.sum(f"_k{k}") for k in ks} | {"_low": F.min("v")}
    carried = {f"_b{k}": F.coalesce(F.sum(f"_e{k}").over(before), F.lit(0.0)) for k in ks} | {f"_t{k}": F.sum(f"_e{k}").over(group) for k in ks}
    held = _over_ranges(held, ["o", "f"], each, carried | {"_next": F.lead("_low").over(group.orderBy("_of"))})
    own = Window.partitionBy("o", "f", "_range").orderBy("_at")
    below = {f"_a{k}": F.col(f"_b{k}") + F.sum(f"_k{k}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for k in ks}
    held = held.withColumns(below | {"_z": F.coalesce(F.lead("v").over(own), F.col("_next"))})
    a, t = [F.col(f"_a{k}") for k in ks], [F.col(f"_t{k}") for k in ks]
    left, n = (sum(a[1:], a[0]), sum(t[1:], t[0])) if classes else (a[0], t[0])
    parts = list(ks) if classes else [1]
    part = lambda s, m: F.try_divide(sum([v * v for v in s[1:]], s[0] * s[0]), m)
    gain = part([a[k] for k in parts], left) + part([t[k] - a[k] for k in parts], n - left) - part([t[k] for k in parts], n)
    ok = (F.col("_z") - F.col("v") >= GAP) & (left >= least) & (n - left >= least) & (gain > 1e-12)
    cut = (F.col("v") + F.col("_z")) / 2
    found = held.select("o", F.when(ok, gain).otherwise(0.0).alias("gain"), (-F.col("f")).alias("f"), F.when(ok, cut).otherwise(0.0).alias("cut"), F.array(*t).alias("s"))
    return found.groupBy("o").agg(F.max_by(F.struct("gain", "f", "cut", "s"), F.struct("gain", "f", -F.col("cut"))).alias("b")).collect()


def _best(rows: DataFrame, trees: list[Tree], block: list[tuple[int, int]], b: Bins, chosen: np.ndarray, classes: int, least: int, exact: bool) -> list[tuple[int, Row]]:
    """(open node, its sums and the cut of largest gain): from bins and, with `exact`, from sorted values of features whose bins are not their values."""
    binned = chosen & np.array(b.exact, bool) if exact else chosen
    found = {}
    if binned.any():
        found = {r.o: r.b for r in _cuts(_sums(rows, trees, block, b, binned, classes), b, classes, least)}
    if (chosen & ~binned).any():
        for r in _sorted_cuts(rows, trees, block, chosen & ~binned, classes, least):
            if r.o not in found or (r.b.gain, r.b.f) > (found[r.o].gain, found[r.o].f):
                found[r.o] = r.b
    return sorted(found.items())


def grow_levels(
    rows: DataFrame, trees: int, classes: int, b: Bins, max_depth: int = 10, min_leaf: int = 1, max_features: int | str = "none", seed: int = 0, exact: bool = False,
) -> list[Tree]:
    """Trees over rows (x, y, w): arrays of features, and of a target and a weight for each tree. `classes` 0 grows regression trees.

    With `exact` cuts lie between any two values, also of features whose bins are not all their values.
    """
    bounded_batches(rows.sparkSession)
    width = len(b.edges)
    many = max((len(e) for e in b.edges), default=1)
    some = max_features if isinstance(max_features, int) else feature_count(max_features, max(1, width))
    grown = _Growing(trees)
    open_nodes = [(t, 0) for t in range(trees)] if width else []
    at_once = max(1, CELLS // (width * many * (classes or 2) or 1))
    for depth in range(max_depth + 1):
        following = []
        for low in range(0, len(open_nodes), at_once):
            block = open_nodes[low : low + at_once]
            chosen = np.zeros((len(block), width), bool)
            for o, (t, node) in enumerate(block):
                chosen[o, np.random.default_rng([seed, t, node]).permutation(width)[:some]] = True
            for o, best in _best(rows, grown.trees(), block, b, chosen, classes, min_leaf, exact):
                t, node = block[o]
                nodes, s = grown.nodes[t], np.array(best.s)
                nodes[node][4:] = [int(s.argmax()), float(s.max() / s.sum())] if classes else [float(s[1] / s[0]), 1.0]
                if depth < max_depth and best.gain > 1e-12:
                    nodes[node][:4] = [-best.f, best.cut, len(nodes), len(nodes) + 1]
                    following += [(t, len(nodes)), (t, len(nodes) + 1)]
                    nodes += [[-1, 0.0, -1, -1, 0.0, 1.0] for _ in range(2)]
        open_nodes = following
        if not open_nodes:
            break
    return grown.trees()


def training_rows(df: DataFrame, features: Sequence[str], targets: Sequence[Column], weights: Sequence[Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., x, y, w) of rows without missing numbers."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    y = F.array(*[t.cast("double") for t in targets])
    w = F.array(*[c.cast("double") for c in weights]) if weights else F.array(*[F.lit(1.0) for _ in targets])
    rows = df.select(*keep, x.alias("_x_"), y.alias("_y_"), w.alias("_w_"))
    whole = ~F.exists(F.concat("_x_", "_y_"), lambda v: v.isNull() | F.isnan(v))
    return rows.where(whole).withColumnsRenamed({"_x_": "x", "_y_": "y", "_w_": "w"})


def forest_levels(df: DataFrame, features: Sequence[str], label: str, classes: int, trees: int = 20, seed: int = 0, bootstrap: bool = True, most_bins: int = BINS, key: str = "id", exact: bool = False, **options) -> list[Tree]:
    """A forest over all rows. With `exact` every cut between two values counts; no bins then: `most_bins` 0. With `bootstrap` a row counts in a tree as often as a Poisson number of mean 1 says that its key gives."""
    weights = None
    if bootstrap:
        u = [F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.col(key)), F.lit(1 << 40)) / float(1 << 40) for t in range(trees)]
        steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(8)])
        weights = [sum(F.when(x >= s, 1).otherwise(0) for s in steps.tolist()) for x in u]
    rows = written(training_rows(df, features, [F.col(label)] * trees, weights).select("x", "y", "w"))
    b = bins(rows, most_bins, not exact) if most_bins else Bins([np.zeros(1) for _ in features], [False for _ in features])
    return grow_levels(rows, trees, classes, b, seed=seed, exact=exact, **options)


def _softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Boosted:
    """Scores start at the logarithms of the classes' shares; each round adds a tree a class."""

    start: np.ndarray
    rounds: list[list[Tree]]
    rate: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.leaves(x)]
        return out


def boosted(
    df: DataFrame, features: Sequence[str], label: str, classes: int, rounds: int = 50, rate: float = 0.1, max_depth: int = 4, min_leaf: int = 1,
    subsample: float = 1.0, max_features: int | str = "none", seed: int = 0, most_bins: int = BINS, key: str = "id",
) -> Boosted:
    """Multinomial boosting: a round fits, for all classes at once, trees on what the softmax of the scores leaves of the labels.

    With `subsample` a round's trees see the rows whose key's hash says so, half of them for 0.5; leaves too.
    """
    rows = training_rows(df, features, [F.col(label)], keep=[key]).select(F.col(key).alias("key"), "x", F.col("y")[0].alias("label"))
    counts = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = np.array([max(counts.get(k, 0), 1e-9) for k in range(classes)], float)
    model = Boosted(np.log(share / share.sum()), [], rate)
    held = written(rows.withColumn("score", F.array(*[F.lit(float(v)) for v in model.start])))
    b = bins(held.select("x"), most_bins)
    per = F.array(*[F.lit(1.0)] * classes)
    for number in range(rounds):
        inside = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.col("key")), F.lit(1 << 40)) < F.lit(subsample * (1 << 40))
        graded = _mapped(held.where(inside) if subsample < 1 else held, lambda x, label, score: np.eye(classes)[label.astype(int)] - _softmax(score), "y")
        graded = written(graded.select("x", "y", per.alias("w")))
        trees = grow_levels(graded, classes, 0, b, max_depth, min_leaf, max_features, seed * 10_007 + number)
        for k, node, r, h in _leaf_sums(graded, trees):
            trees[k].value[node] = (classes - 1) / classes * r / h if h > 1e-150 else 0.0
        model.rounds.append(trees)
        step = Boosted(np.zeros(classes), [trees], rate)
        held = written(_mapped(held, lambda x, label, score, step=step: score + step.scores(x), "score", ["key"]))
    return model


def _mapped(rows: DataFrame, work: Callable, output: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., x, label, output) with an array that `work` makes of x, label and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = len(keep)
                made = work(_vectors(batch.column(n)), batch.column(n + 1).to_numpy(), _vectors(batch.column(n + 2)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], lists], names=[*keep, "x", "label", output])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "x", "label", "score").mapInArrow(run, ", ".join([*kinds, "x array<double>", "label double", f"{output} array<double>"]))


def _leaf_sums(graded: DataFrame, trees: list[Tree]) -> list[tuple[int, int, float, float]]:
    """(tree, leaf, sum of gradients, sum of |gradient| (1 - |gradient|)); a row a leaf."""
    sent = graded.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _vectors(batch.column(0)), _vectors(batch.column(1))
            for k, tree in enumerate(sent.value):
                at, r = tree.leaves(x), y[:, k]
                size = len(tree.feature)
                node = np.arange(size, dtype=np.int32)
                sums = [np.bincount(at, v, size) for v in (r, np.abs(r) * (1 - np.abs(r)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(node), *map(pa.array, sums)], names=["tree", "node", "r", "h"])

    found = graded.select("x", "y").mapInArrow(run, "tree int, node int, r double, h double").groupBy("tree", "node").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return [tuple(r) for r in found.collect()]


def with_classes(df: DataFrame, model: Boosted, features: Sequence[str], output: str = "prediction", probability: str = "probability") -> DataFrame:
    """Adds the class of the largest score, the first on ties, and the classes' probabilities."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def scored(x):
        import pandas as pd

        return pd.Series(list(_softmax(held.value.scores(np.array(x.tolist(), float).reshape(len(x), -1)))))

    out = df.withColumn(probability, scored(F.array(*[F.col(f).cast("double") for f in features])))
    return out.withColumn(output, (F.array_position(probability, F.array_max(probability)) - 1).cast("double"))

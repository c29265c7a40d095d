"""Balanced boxes of points by recursive median cuts, with the points around each box.

A round samples the points of every box that is still too large (a bounded number, chosen by a hash of the id), cuts the sample
at medians again and again, and deals all points of the box to the parts. A cut goes across the axis where the fewest points
lie within the halo's reach of it, and is made only if those are a minority; points that no cut can part stay in one box.
A copy of each point goes to every other box that it is within reach of (the halo), so whatever lies within reach of a point is in
the point's own box. Each box is cut by its own sample, so dense regions get many small boxes, sparse ones few, and the number of
rounds grows with the logarithm of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.lineage import bounded_batches, written

SAMPLE = 4096  # points of a box, about, that its cuts are taken from
LEAST = 16  # points of the sample that a part keeps
MOST_PARTS = 1024  # of a box in a round; a sample gives some 256
WIDEST = 0.5  # share of the points that may lie within reach of a cut

_TREE = "axis array<int>, cut array<double>, left array<int>, right array<int>"


def cut_tree(sample: np.ndarray, reach: float, leaves: int) -> dict[str, list]:
    """Nodes of a tree of cuts: axis -1 is a part, whose number stands in `left`."""
    tree: dict[str, list] = {"axis": [], "cut": [], "left": [], "right": []}
    parts = 0
    most = max(LEAST, -(-len(sample) // leaves))
    todo = [(np.arange(len(sample)), None, "")]
    while todo:
        rows, parent, side = todo.pop()
        node = len(tree["axis"])
        if parent is not None:
            tree[side][parent] = node
        for name, value in zip(tree, (-1, 0.0, -1, -1)):
            tree[name].append(value)
        x = sample[rows]
        best = None
        if len(rows) > most and len(rows) >= 2 * LEAST and x.shape[1]:
            middle = np.partition(x, (len(x) - 1) // 2, axis=0)[(len(x) - 1) // 2]
            low = x <= middle
            share = (np.abs(x - middle) <= reach).mean(0)
            share[(~low).sum(0) < LEAST] = 1.0  # one value holds all above the median
            spread = x.max(0) - x.min(0)
            axis = int(np.lexsort((-spread, share))[0])
            if share[axis] < WIDEST:
                best = axis, float(middle[axis]), low[:, axis]
        if best is None:
            tree["left"][node] = parts
            parts += 1
            continue
        axis, cut, under = best
        tree["axis"][node], tree["cut"][node] = axis, cut
        todo += [(rows[~under], node, "right"), (rows[under], node, "left")]
    return tree


def _routed(tree: dict[str, list], x: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, own): where each row goes; a row that is not own goes to every part that it may be near."""
    rows, parts, owns = [], [], []
    todo = [(0, np.arange(len(x)), own)]
    while todo:
        node, at, mine = todo.pop()
        axis = tree["axis"][node]
        if axis < 0:
            rows.append(at)
            parts.append(np.full(len(at), tree["left"][node]))
            owns.append(mine)
            continue
        gap = x[at, axis] - tree["cut"][node]
        under = gap <= 0
        for child, inside, near in ((tree["left"][node], under, gap <= reach), (tree["right"][node], ~under, -gap <= reach)):
            # what is inside keeps its standing; what is only near comes as a copy
            goes = inside | near
            if goes.any():
                todo.append((child, at[goes], (mine & inside)[goes]))
    return np.concatenate(rows), np.concatenate(parts), np.concatenate(owns)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def boxed(points: DataFrame, reach: float, most: int, id_col: str = "id", features: str = "x", rounds: int = 6, sample: int = SAMPLE) -> DataFrame:
    """(id, x, box, own) of points whose ids are numbers: own once for each point, and copies for the boxes it is within `reach` of.

    Boxes hold about `most` points of their own, or more where no cut parts them. With a negative reach there are no copies.
    """
    bounded_batches(points.sparkSession)
    extra = [c for c in points.columns if c not in (id_col, features)]
    held = points.select(F.col(id_col).alias("id"), F.col(features).alias("x"), F.lit(0).cast("bigint").alias("box"), F.lit(True).alias("own"), F.lit(False).alias("_done"), *extra)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.array(batch.column(2)[i].as_py(), float)
                tree = cut_tree(x, reach, -(-batch.column(1)[i].as_py() // most))
                kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([v], k) for v, k in zip(tree.values(), kinds)]], names=["_box", *tree])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 5 + len(extra)
        for batch in batches:
            box = batch.column(2).to_numpy()
            order = np.argsort(box, kind="stable")
            cuts = np.flatnonzero(np.diff(box[order])) + 1
            for at in np.split(order, cuts):
                part = batch.take(pa.array(at))
                tree = {n: part.column(width + k)[0].as_py() for k, n in enumerate(("axis", "cut", "left", "right"))}
                if tree["axis"] is None:  # a box that is small enough
                    yield pa.RecordBatch.from_arrays(part.columns[:width], names=part.schema.names[:width])
                    continue
                row, sub, own = _routed(tree, _vectors(part.column(1)).astype(float), part.column(3).to_numpy(zero_copy_only=False), reach)
                out = part.take(pa.array(row))
                many = len(tree["axis"])
                done = pa.array(np.full(len(row), many == 1))  # nothing parts it
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(box[at[0]] * MOST_PARTS + sub + (many > 1)), pa.array(own), done, *out.columns[5:width]], names=part.schema.names[:width])

    for _ in range(rounds):
        sizes = written(held.where("own and not _done").groupBy("box").agg(F.count("*").alias("_n")).where(F.col("_n") > most))
        open_boxes = sizes.count()
        if not open_boxes:
            break
        chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(sample) * (1 << 30)) / F.col("_n")
        few = F.broadcast(sizes) if open_boxes <= 100_000 else sizes
        drawn = held.where("own").select("box", "id", "x").join(few, "box").where(chance)
        drawn = drawn.groupBy("box", "_n").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("_s"))  # about `sample` points a box
        trees = drawn.select(F.col("box").alias("_box"), F.col("_n").cast("bigint"), F.transform("_s", lambda s: s["x"]).alias("_x"))
        trees = written(trees.mapInArrow(plan, f"_box bigint, {_TREE}"))
        near = F.broadcast(trees) if open_boxes <= 1_000 else trees  # a tree has up to some 500 nodes of 20 bytes
        held = held.join(near, held["box"] == near["_box"], "left").drop("_box")
        held = written(held.mapInArrow(deal, fields))
    return held.drop("_done")

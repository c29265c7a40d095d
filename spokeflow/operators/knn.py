"""The nearest neighbours of many points, by boxes of points and their bounds.

Points are parted into cells of about `block` points by recursive median cuts, and cells in their order into halls. A point first finds
neighbours in its own cell; the distance of the k-th bounds what is left to look at. In a second round it goes once to every hall
that has a cell whose bounding box is not farther than that, and to no others. There it meets runs of some cells within its bound:
their distances come from one product of matrices, those that may be near enough are taken exactly, and the bound falls from run to run.
What comes back is k rows a point and visited hall.

In many dimensions boxes overlap and most halls are visited: the work is then that of comparing all with all, in units of two sides of
`SIDE_BYTES` at most, and nothing is stored beyond the k nearest of a hall. Rows that travel are the pairs of points over such a side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.operators.boxes import _vectors, boxed
from spokeflow.operators.dbscan import _by_unit
from spokeflow.plans.lineage import bounded_batches, written
from spokeflow.plans.spread import summed

BLOCK = 512  # points of a cell, about
STRIDE = 16  # dimensions that are summed before a pair is judged again
PAIRS = 1 << 18  # pairs whose sums are held at once
RUN = 2048  # points of a hall that are compared at once
SIDE_BYTES = 16 << 20  # points of a hall, and of those that come to it in one unit
LEAST_HALLS = 8  # that few points are still dealt to
BOUNDS_BYTES = 16 << 20  # bounding boxes that go to every task in one pass


def k_best(q: np.ndarray, ids: np.ndarray, bound: np.ndarray, y: np.ndarray, jds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, row of y, squared distance) of the k nearest of y for each q within its squared bound, itself left out, and the terms summed."""
    found, terms = [], 0
    step = max(1, PAIRS // max(1, len(y)))
    slack = bound * (1 + 1e-9)
    for at in range(0, len(q), step):
        i, j = np.nonzero(ids[at : at + step, None] != jds[None, :])
        i += at
        part = np.zeros(len(i))
        for c in range(0, q.shape[1], STRIDE):
            d = q[i, c : c + STRIDE] - y[j, c : c + STRIDE]
            terms += d.size
            part += np.einsum("ij,ij->i", d, d)
            left = part <= slack[i]
            if not left.all():
                i, j, part = i[left], j[left], part[left]
        exact = ((q[i] - y[j]) ** 2).sum(-1)
        order = np.lexsort((jds[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i, side="left")
        near = np.arange(len(i)) - first < k
        found.append((i[near], j[near], exact[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return (*(np.concatenate(c) for c in zip(*found)), terms)


def k_near(q: np.ndarray, ids: np.ndarray, bound: np.ndarray, own: np.ndarray, y: np.ndarray, jds: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of q, id of y, squared distance) of the k nearest of y, those of a q's own cell left out, within its squared bound; ties go to the smaller id."""
    order = np.argsort(cell, kind="stable")
    y, jds, cell = y[order], jds[order], cell[order]
    q2, y2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", y, y)
    nobody = np.iinfo(np.int64).max
    best, who = np.full((len(q), k), np.inf), np.full((len(q), k), nobody)
    step = max(1, 4 * PAIRS // RUN)
    for low in range(0, len(y), RUN):
        z, z2, names, home = y[low : low + RUN], y2[low : low + RUN], jds[low : low + RUN], cell[low : low + RUN]
        floor, top = z.min(0), z.max(0)
        for at in range(0, len(q), step):
            part = q[at : at + step]
            limit = np.minimum(bound[at : at + step], best[at : at + step, -1]) * (1 + 1e-9)
            gap = np.maximum(np.maximum(floor - part, part - top), 0)
            some = np.flatnonzero(~(np.einsum("ij,ij->i", gap, gap) > limit)) + at
            if not len(some):
                continue
            d = q[some] @ (-2 * z.T)
            d += q2[some, None]
            d += z2
            limit = limit[some - at]
            i, j = np.nonzero(~(d > (limit + 1e-11 * (q2[some] + z2.max()))[:, None]))  # more than products are rounded by
            exact = np.concatenate([((q[some[i[c : c + PAIRS // 4]]] - z[j[c : c + PAIRS // 4]]) ** 2).sum(-1) for c in range(0, len(i), PAIRS // 4)] or [np.zeros(0)])
            fits = (exact <= limit[i]) & (own[some[i]] != home[j])
            i, exact, name = some[i[fits]], exact[fits], names[j[fits]]
            rows = np.unique(i)
            row, value, name = np.append(np.repeat(rows, k), i), np.append(best[rows].ravel(), exact), np.append(who[rows].ravel(), name)
            order = np.lexsort((name, value, row))
            row, value, name = row[order], value[order], name[order]
            near = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            best[rows], who[rows] = value[near].reshape(-1, k), name[near].reshape(-1, k)
    found = who != nobody
    return np.repeat(ids, found.sum(1)), who[found], best[found]


def _bounds(cells: DataFrame) -> DataFrame:
    """cell, low and high: the corners of the box around a cell's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, x = batch.column(0).to_numpy(), _vectors(batch.column(1)).astype(float)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else []
            if not len(starts) or not x.shape[1]:
                continue
            low, high = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
            n, d = low.shape
            out = [np.repeat(cell[order][starts], d), np.tile(np.arange(d, dtype=np.int32), n), low.ravel(), high.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["cell", "i", "low", "high"])

    sides = cells.select("cell", "x").mapInArrow(run, "cell bigint, i int, low double, high double")
    sides = sides.groupBy("cell", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    corners = sides.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("s"))  # a row a dimension
    return corners.select("cell", F.transform("s", lambda s: s["low"]).alias("low"), F.transform("s", lambda s: s["high"]).alias("high"))


def _visits(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(hall, id, x, bound, cell) for each query and each hall that has a cell, not its own, whose box is within the query's bound.

    Boxes are taken in blocks of `BOUNDS_BYTES` of whole halls, each sent to every worker for one pass over the queries.
    """
    found, held, size = None, [], 0
    fields = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("id", "x", "bound", "cell"))

    def one(block: list) -> DataFrame:
        corners = (np.array([b.cell for b in block], np.int64), np.array([b.hall for b in block], np.int64), np.array([b.low for b in block], float), np.array([b.high for b in block], float))
        sent = queries.sparkSession.sparkContext.broadcast(corners)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, halls, low, high = sent.value
            names, place = np.unique(halls, return_inverse=True)
            for batch in batches:
                x, bound, own = _vectors(batch.column(1)).astype(float), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                step = max(1, PAIRS // max(1, len(cells)))
                for at in range(0, len(x), step):
                    q, far = x[at : at + step], bound[at : at + step, None] * (1 + 1e-9)
                    gap = np.zeros((len(q), len(cells)))
                    for c in range(q.shape[1]):
                        side = np.maximum(np.maximum(low[:, c] - q[:, c, None], q[:, c, None] - high[:, c]), 0)
                        gap += side * side
                    i, j = np.nonzero((gap <= far) & (own[at : at + step, None] != cells))
                    if len(i):
                        i, j = np.divmod(np.unique(i * len(names) + place[j]), len(names))
                        went = batch.take(pa.array(i + at))
                        yield pa.RecordBatch.from_arrays([pa.array(names[j]), *went.columns], names=["hall", "id", "x", "bound", "cell"])

        return queries.select("id", "x", "bound", "cell").mapInArrow(run, f"hall bigint, {fields}")

    for row in bounds.orderBy("hall").toLocalIterator():
        if size >= BOUNDS_BYTES and row.hall != held[-1].hall:
            part = one(held)
            found, held, size = part if found is None else found.unionByName(part), [], 0
        held.append(row)
        size += 16 * len(row.low) + 16
    if held or found is None:
        part = one(held)
        found = part if found is None else found.unionByName(part)
    return found


def nearest_neighbour_join(points: DataFrame, k: int, id_col: str = "id", features: str = "features", which: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(query, id, distance, rank): the k nearest other points of every point, or of those that `which` (over id) picks. Ties go to the smaller id.

    Ids are numbers and tell points apart; a table of one point has no neighbours; points with equal values may fill many cells.
    """
    bounded_batches(points.sparkSession)
    floats = points.schema[features].dataType.elementType.simpleString() == "float"  # are sent as they are and compared as doubles
    pts = points.select(F.col(id_col).alias("id"), (F.col(features) if floats else F.transform(features, lambda v: v.cast("double"))).alias("x"))
    held = boxed(pts, -1.0, block).select("id", "x", "box")
    sizes = written(held.groupBy("box").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))  # a box that no cut parts is dealt by hash
    dealt = written(held.join(sizes, "box").select("id", "x", "box", part.alias("part")))
    counts = written(dealt.groupBy("box", "part").agg(F.count("*").alias("n")))
    rows, dims = counts.agg(F.sum("n")).first()[0] or 0, (dealt.select(F.size("x")).first() or [0])[0]
    side = max(2 * block, min(-(-rows // LEAST_HALLS), SIDE_BYTES // (8 * max(1, dims))))
    order = summed(counts, [], ["box", "part"], F.col("n"), "cell").select("box", "part", F.col("cell").cast("bigint"), F.floor((F.col("cell") - F.col("n")) / side).alias("hall"))
    cells = written(dealt.join(written(order), ["box", "part"]).select("id", "x", "cell", "hall"))
    asked = cells if which is None else cells.where(which)

    def best(ids, x, extra, jds, y, _, __, ___):
        i, j, d, _ = k_best(x, ids, extra[0].astype(float), y, jds, k)
        return ids[i], jds[j], d

    def near(ids, x, extra, jds, y, there, __, ___):
        return k_near(x, ids, extra[0].astype(float), extra[1], y, jds, there[1], k)

    def answered(queries: DataFrame, unit: Column, there: DataFrame, work: Callable) -> DataFrame:
        mine = queries.select(unit.alias("unit"), F.lit(0).alias("side"), "id", "x", "bound", "cell")
        return _by_unit(mine.unionByName(there), work, "query bigint, id bigint, d double")

    inside = cells.select(F.col("cell").alias("unit"), F.lit(1).alias("side"), "id", "x", F.lit(0.0).alias("bound"), "cell")
    first = written(answered(asked.withColumn("bound", F.lit(float("inf"))), F.col("cell"), inside, best))
    reach = first.groupBy(F.col("query").alias("_q")).agg(F.when(F.count("*") == k, F.max("d")).alias("_d"))
    bounded = written(asked.join(reach, asked["id"] == F.col("_q"), "left").select("id", "x", "cell", F.coalesce("_d", F.lit(float("inf"))).alias("bound")))
    bounds = written(_bounds(cells).join(cells.select("cell", "hall").distinct(), "cell"))
    visits = written(_visits(bounded, bounds))
    crowds = written(visits.groupBy("hall").agg(F.ceil(F.count("*") / side).cast("int").alias("_crowds")))
    unit = F.xxhash64("hall", "_c")
    there = cells.join(crowds, "hall").withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_crowds") - 1)))
    there = there.select(unit.alias("unit"), F.lit(1).alias("side"), "id", "x", F.lit(0.0).alias("bound"), "cell")
    came = visits.join(crowds, "hall").withColumn("_c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_crowds")).cast("int"))
    second = answered(came, unit, there, near)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    every = first.unionByName(second).withColumn("rank", rank).where(F.col("rank") <= k)
    return every.select("query", "id", F.sqrt("d").alias("distance"), "rank")

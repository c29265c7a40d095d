"""Density clustering and neighbours by balanced boxes of points.

Points are dealt to boxes by median cuts (`boxes`), each box with copies of the points around it, so all neighbours of a point
are in its own box. A box's points are taken in blocks of at most about BLOCK; a block with itself and the copies around it, or two
blocks of a box, are one unit of work: its points meet in one task, which takes their distances as one matrix product and, where
a distance is too near eps to tell, once more in the order of the dimensions. What comes out of a unit is counts per point
and at most one link per merge of clusters, never pairs, unless pairs are asked for.

Dense regions get small boxes, so a point is compared with what lies around it. Where no cut parts the points (many dimensions, wide
eps) they stay in one box whose blocks all meet: the work is that of comparing all with all, the shuffle a BLOCK-th of it.
`work_of` tells what a setting costs.

`dbscan` needs less than the counts: which points are core points, and what hangs together. Points travel in chunks of up to `CHUNK_BYTES`, a row
each. A chunk meets itself first, then each other chunk of its box and the points around the box. Two points that are
known to be core points of one cluster need not be compared any more, so in a dense box work falls to what its chunks take to
find that out, and to the points that stay no core points against all. Where points have few neighbours all are compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.operators.boxes import boxed
from spokeflow.operators.components import few_or_many_components
from spokeflow.plans.lineage import bounded_batches, written

BLOCK = 4096  # points of a block, about: a point is sent once for each block of its box
STRIP = 512  # points of a block whose distances are held at once
TILE = 4096  # points that a strip meets at once
CHUNK_BYTES = 8 << 20  # points of a chunk, which travels as one row
LEAST_CHUNKS = 8  # that a box of many points is dealt to
UNROLLED = 128  # dimensions up to which a distance is written out, which compiles; a lambda is interpreted


def squared_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    """Sum of squared differences, in the order of the dimensions."""
    if dims and dims <= UNROLLED:
        d = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(dims)]
        return reduce(lambda s, v: s + v, [v * v for v in d])
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def _units(points: DataFrame, eps: float, id_col: str, features: str, block: int) -> DataFrame:
    """(unit, side, id, x): side 0 and 1 are two blocks of a box, 2 a block that also meets itself, 3 points around the box."""
    narrow = points.schema[features].dataType.elementType.simpleString() == "float"  # sent as they are, half as wide
    x = F.col(features) if narrow else F.transform(F.col(features), lambda v: v.cast("double"))
    held = boxed(points.select(F.col(id_col).alias("id"), x.alias("x")), eps, block)
    sizes = held.groupBy("box").agg(F.count_if("own").alias("_own"), F.count_if(~F.col("own")).alias("_around"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    sizes = written(sizes.select("box", parts("_own").alias("_blocks"), parts("_around").alias("_rings")))
    held = held.join(sizes, "box").withColumn("_at", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("_blocks")).otherwise(F.col("_rings"))).cast("int"))
    # a block meets itself and ring 0 in one unit, each other ring and each later block in one more
    unit = lambda kind, i, j: F.xxhash64("box", F.lit(kind), i, j)
    at, none = F.col("_at"), F.lit(0)
    to = lambda side, u: F.struct(F.lit(side).alias("side"), u.alias("unit"))
    later = F.transform(F.sequence(at, F.col("_blocks") - 1), lambda j: F.when(j == at, to(2, unit("own", at, none))).otherwise(to(0, unit("pair", at, j))))
    earlier = F.transform(F.filter(F.sequence(none, at), lambda i: i < at), lambda i: to(1, unit("pair", i, at)))
    rings = F.transform(F.filter(F.sequence(none, F.col("_rings") - 1), lambda r: r > 0), lambda r: to(0, unit("ring", at, r)))
    around = F.transform(F.sequence(none, F.col("_blocks") - 1), lambda i: to(3, F.when(at == 0, unit("own", i, none)).otherwise(unit("ring", i, at))))
    goes = F.when(F.col("own"), F.concat(later, earlier, rings)).otherwise(around)
    return held.select("id", "x", F.explode(goes).alias("_u")).select(F.col("_u.unit").alias("unit"), F.col("_u.side").alias("side"), "id", "x")


def work_of(points: DataFrame, eps: float, id_col: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """One row: points, rows that are sent to units, and pairs of points that the units compare."""
    sides = _units(points, eps, id_col, features, block).groupBy("unit").agg(*[F.count_if(F.col("side") == s).alias(f"n{s}") for s in range(4)])
    n2 = F.col("n2")
    pairs = F.col("n0") * (F.col("n1") + F.col("n3")) + n2 * F.col("n3") + n2 * (n2 - 1) / 2
    rows = sum(F.col(f"n{s}") for s in range(4))
    return sides.agg(F.sum(rows).alias("rows"), F.sum(pairs).cast("bigint").alias("pairs")).select(F.lit(points.count()).alias("points"), "rows", "pairs")


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a are within eps of which rows of b, a strip of a at a time."""
    near = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), STRIP):
        near[at : at + STRIP] = _strip_near(a[at : at + STRIP], b, eps)
    return near


def _strip_near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    limit = eps * eps
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    d = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    near = d <= limit
    doubt = 1e-12 * (aa.max(initial=0) + bb.max(initial=0) + limit) * max(1, a.shape[1])
    i, j = np.nonzero(np.abs(d - limit) <= doubt)
    for at in range(0, len(i), 1 << 16):
        r, c = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[r, c] = np.cumsum((a[r] - b[c]) ** 2, axis=1)[:, -1] <= limit if a.shape[1] else True
    return near


def _by_unit(units: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Runs work(ids_a, x_a, extra_a, ids_b, x_b, extra_b, itself, around) -> columns over each unit; rows come sorted by unit and side.

    `itself`: the points of a also meet each other. `around`: b are copies, which get their own counts and links in their own box.
    """
    bounded_batches(units.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    extra = units.columns[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch | None:
            side, ids, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            x = x.astype(float)
            rest = [np.concatenate([h[3 + k] for h in held]) for k in range(len(extra))]
            a, b, itself = (side == 0) | (side == 2), (side == 1) | (side == 3), bool((side == 2).any())
            if not a.any() or not (itself or b.any()):
                return None
            found = work(ids[a], x[a], [r[a] for r in rest], ids[b], x[b], [r[b] for r in rest], itself, not (side == 1).any())
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names) if len(found[0]) else None

        for batch in batches:
            unit = batch.column(0).to_numpy()
            x = batch.column(3)
            width = len(x[0]) if len(x) else 0
            x = x.flatten().to_numpy().reshape(len(unit), width)
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(unit)).tolist()):
                if held and unit[lo] != now:
                    if (out := done()) is not None:
                        yield out
                    held.clear()
                now = unit[lo]
                held.append((batch.column(1).to_numpy()[lo:hi], batch.column(2).to_numpy()[lo:hi], x[lo:hi], *[batch.column(4 + k).to_numpy(zero_copy_only=False)[lo:hi] for k in range(len(extra))]))
        if held and (out := done()) is not None:
            yield out

    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return units.repartition(parts, "unit").sortWithinPartitions("unit", "side", "id").mapInArrow(run, schema)


def _own_near(x: np.ndarray, eps: float) -> np.ndarray:
    """Which different rows of x are within eps of each other."""
    near = _near(x, x, eps)
    np.fill_diagonal(near, False)
    return near


def neighbour_counts(points: DataFrame, eps: float, id_col: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """(id, n) of points with neighbours: how many other points lie within eps. Ids are numbers and tell points apart."""

    def count(ids, x, _, jds, y, __, itself, around):
        near = _near(x, y, eps)
        a = near.sum(1) + (_own_near(x, eps).sum(1) if itself else 0)
        if around:
            return ids[a > 0], a[a > 0].astype(np.int64)
        b = near.sum(0)
        return np.concatenate([ids[a > 0], jds[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(np.int64)

    units = _units(points, eps, id_col, features, block)
    return _by_unit(units, count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def neighbour_pairs(points: DataFrame, eps: float, id_col: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """(a, b) for all ordered pairs of different points within eps, where the pairs themselves are wanted."""

    def pairs(ids, x, _, jds, y, __, itself, around):
        i, j = np.nonzero(_near(x, y, eps))
        found = [(ids[i], jds[j])] + ([] if around else [(jds[j], ids[i])])
        if itself:
            i, j = np.nonzero(_own_near(x, eps))
            found.append((ids[i], ids[j]))
        return tuple(np.concatenate(c) for c in zip(*found))

    return _by_unit(_units(points, eps, id_col, features, block), pairs, "a bigint, b bigint")


class _Known:
    """What is known of the points of a unit: neighbours seen, and which core points by those hang together.

    `names` are ids of clusters that the points are known to be in, their own ids where that is not known. Of the pairs of points, only those
    are kept with a point that is no core point yet, which are fewer than `need` for each such point.
    """

    def __init__(self, names: np.ndarray, seen: np.ndarray, need: int) -> None:
        self.names, self.label = np.unique(names, return_inverse=True)
        self.lead = np.arange(len(self.names))
        self.seen, self.need, self.core = seen.astype(np.int64), need, seen >= need
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs within reach, each once."""
        if not len(i):
            return
        n = len(self.seen)
        self.seen += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        self.core = self.seen >= self.need
        self._join(i, j)

    def settle(self) -> None:
        """Joins what kept pairs show by now."""
        if self.kept:
            i, j = (np.concatenate(c) for c in zip(*self.kept))
            self.kept.clear()
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        solid = self.core[i] & self.core[j]
        if not solid.all():
            self.kept.append((i[~solid], j[~solid]))
        i, j = i[solid], j[solid]
        while (apart := self.label[i] != self.label[j]).any():
            i, j = i[apart], j[apart]
            a, b = self.label[i], self.label[j]
            np.minimum.at(self.lead, np.maximum(a, b), np.minimum(a, b))
            while (self.lead[self.lead] != self.lead).any():
                self.lead = self.lead[self.lead]
            self.label = self.lead[self.label]

    def roots(self) -> np.ndarray:
        """The smallest name of what each point hangs together with."""
        return self.names[self.label]

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept pairs, of a point and what hangs together in its reach only one."""
        self.settle()
        if not self.kept:
            return ids[:0], ids[:0]
        (i, j), n = self.kept[0], len(ids)
        i, j = np.where(self.core[j], j, i), np.where(self.core[j], i, j)
        i, j = np.divmod(np.unique(np.where(self.core[i], self.label[i] + n, i) * n + j), n)  # there are no more labels than points
        return np.where(i < n, ids[np.minimum(i, n - 1)], self.names[np.maximum(i - n, 0)]), ids[j]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Names that turned out to be those of one cluster."""
        old = np.flatnonzero(self.lead != np.arange(len(self.lead)))
        return self.names[old], self.names[self.lead[old]]


class _Reach:
    """Which points of x are within eps of each other: products of matrices around the points' middle, in single precision where that tells
    nearly all pairs apart; pairs too near eps to tell are taken once more in the order of the dimensions."""

    def __init__(self, x: np.ndarray, eps: float) -> None:
        self.x, self.limit = x, eps * eps
        self.whole = np.isfinite(x).all(1)  # nothing is near what is not a number
        middle = x[self.whole].mean(0, dtype=float) if self.whole.any() else 0.0
        y = np.where(self.whole[:, None], x - middle, 0.0)
        y2 = np.einsum("ij,ij->i", y, y)
        size = 2 * y2.max(initial=0) + self.limit
        self.doubt, kind = 8 * (x.shape[1] + 8) * 2.0**-24 * size, np.float32
        if not self.doubt <= 1e-3 * self.limit or size > 1e37:
            self.doubt, kind = 1e-12 * size * max(1, x.shape[1]), float
        one = np.ones((len(x), 1), kind)
        self.a = np.hstack([y.astype(kind), y2[:, None].astype(kind), one])
        self.b = np.hstack([(-2 * y).astype(kind), one, (y2 - self.limit)[:, None].astype(kind)])

    def of(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, column) of near pairs, a tile at a time."""
        rows, columns = rows[self.whole[rows]], columns[self.whole[columns]]
        a = self.a[rows]
        for at in range(0, len(columns) if len(rows) else 0, TILE):
            some = columns[at : at + TILE]
            d = (a @ self.b[some].T).ravel()
            near = np.flatnonzero(d <= self.doubt)
            unsure = d[near] >= -self.doubt
            i, j = np.divmod(near, len(some))
            i, j = rows[i], some[j]
            if unsure.any():
                keep = ~unsure
                held = np.flatnonzero(unsure)
                for k in range(0, len(held), 1 << 16):
                    some_held = held[k : k + (1 << 16)]
                    gap = self.x[i[some_held]].astype(float) - self.x[j[some_held]]
                    keep[some_held] = np.cumsum(gap * gap, axis=1)[:, -1] <= self.limit if gap.shape[1] else True
                i, j = i[keep], j[keep]
            yield i, j


def _meet(known: _Known, reach: _Reach, mine: int, itself: bool) -> None:
    """Lets the first `mine` points meet each other or, not `itself`, all that follow. Core points of one cluster are not compared."""
    todo, others = np.arange(mine), np.arange(mine, len(known.seen))
    while len(todo):
        label = np.where(known.core[todo], known.label[todo], len(known.names))
        many = np.bincount(label, minlength=len(known.names) + 1)
        many[-1] = 0
        alike = label == label[0] if many[label[0]] > STRIP // 8 else many[label] <= STRIP // 8
        at = np.flatnonzero(alike)[:STRIP]
        rows, one = todo[at], many[label[0]] > STRIP // 8
        if itself:
            others = todo
        todo = np.delete(todo, at)
        columns = others[~(known.core[others] & (known.label[others] == label[0]))] if one else others
        first = np.zeros(len(known.seen), bool)
        first[rows] = True
        for i, j in reach.of(rows, columns):
            if itself:
                once = ~first[j] | (i < j)
                i, j = i[once], j[once]
            known.add(i, j)
        known.settle()


_CHUNK = "box bigint, own boolean, part int, ids binary, x binary, seen binary, root binary, a binary, b binary"


def _chunks(points: DataFrame, eps: float, need: int, id_col: str, features: str, block: int) -> DataFrame:
    """A row for each chunk of a box's own points, which have met each other, and for each chunk of the points around it."""
    narrow = points.schema[features].dataType.elementType.simpleString() == "float"  # sent as they are, half as wide
    kind = np.float32 if narrow else float
    x = F.col(features) if narrow else F.transform(F.col(features), lambda v: v.cast("double"))
    held = boxed(points.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")), eps, block)
    most = F.floor(F.lit(CHUNK_BYTES // np.dtype(kind).itemsize) / F.greatest(F.max(F.size("x")), F.lit(1)))
    parts = lambda n: F.ceil(n / F.greatest(F.lit(block), F.least(most, F.ceil(n / LEAST_CHUNKS)))).cast("int")
    sizes = written(held.groupBy("box", "own").agg(parts(F.count("*")).alias("_parts")))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    held = held.join(sizes, ["box", "own"]).select(F.xxhash64("box", "own", part).alias("unit"), F.lit(2).alias("side"), "id", "x", "box", "own", part.alias("part"))

    def chunk(ids, x, extra, *_):
        known = _Known(ids, np.zeros(len(ids), np.int64), need)
        own = bool(extra[1][0])
        if own:
            _meet(known, _Reach(x, eps), len(ids), True)
        packed = (ids, x.astype(kind), known.seen, np.where(known.core, known.roots(), ids), *(known.pairs(ids) if own else (ids[:0], ids[:0])))
        return ([extra[0][0]], [own], [extra[2][0]], *([c.tobytes()] for c in packed))

    return written(_by_unit(held, chunk, _CHUNK))


def _numbers(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    held = column[0].as_buffer()
    return np.frombuffer(held, kind) if held.size else np.zeros(0, kind)


def _unpacked(chunks: DataFrame, columns: Sequence[str], schema: str) -> DataFrame:
    """A row for each number of these packed columns."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(c.slice(k, 1))) for c in batch.columns], names=names)

    return chunks.select(*columns).mapInArrow(run, schema)


def _meetings(chunks: DataFrame, eps: float, need: int, kind: type) -> DataFrame:
    """(a, b, n): n neighbours of a, or with n NULL two names that hang together if both are core points, or whose cluster the other one borders on."""
    counts = written(chunks.groupBy("box").agg(F.count_if("own").cast("int").alias("_blocks"), F.count_if(~F.col("own")).cast("int").alias("_rings")))
    blocks, rings, at = F.col("_blocks"), F.col("_rings"), F.col("part")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    unit = lambda name, i, j: F.xxhash64("box", F.lit(name), i, j)
    to = lambda side, u: F.struct(F.lit(side).alias("side"), u.alias("unit"))
    pairs = F.transform(F.filter(upto(blocks), lambda j: j != at), lambda j: F.when(j > at, to(0, unit("pair", at, j))).otherwise(to(1, unit("pair", j, at))))
    own = F.concat(pairs, F.transform(upto(rings), lambda r: to(0, unit("ring", at, r))))
    around = F.transform(upto(blocks), lambda i: to(3, unit("ring", i, at)))
    units = chunks.join(counts, "box").withColumn("_u", F.explode(F.when(F.col("own"), own).otherwise(around)))
    units = units.select("_u.unit", "_u.side", "ids", "x", "seen", "root")
    many = counts.agg(F.sum(blocks * (blocks - 1) / 2 + blocks * rings)).first()[0] or 0
    least = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                unit, side, *packed = batch.slice(k, 1).columns
                ids, seen, root = (_numbers(packed[c]) for c in (0, 2, 3))
                x = _numbers(packed[1], kind).reshape(len(ids), -1)
                if side[0].as_py() == 0:
                    now, mine = unit[0].as_py(), (ids, x, seen, root)
                    continue
                if unit[0].as_py() != now:
                    raise ValueError("a chunk without its partner")
                n, every = len(mine[0]), np.concatenate([mine[0], ids])
                before = np.concatenate([mine[2], seen])
                known = _Known(np.concatenate([mine[3], root]), before, need)
                _meet(known, _Reach(np.concatenate([mine[1], x]), eps), n, False)
                more = np.where(before < need, known.seen - before, 0)
                if side[0].as_py() == 3:
                    more[n:] = 0  # counted in their own box
                some = np.flatnonzero(more)
                a, b = (np.concatenate(c) for c in zip(known.pairs(every), known.joined()))
                out = [pa.array(np.concatenate([every[some], a])), pa.array(np.concatenate([np.zeros(len(some), np.int64), b])), pa.array([*more[some].tolist(), *[None] * len(a)], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "n"])

    dealt = units.repartition(max(least, min(int(many), 16 * least)), "unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def dbscan(
    points: DataFrame, eps: float, min_points: int, id_col: str = "id", features: str = "features",
    count_self: bool = True, block: int = BLOCK, lone_is_noise: bool = False,
) -> DataFrame:
    """id, cluster, core. Noise has cluster NULL. Ids are numbers and tell points apart.

    A core point has `min_points` neighbours, itself included or not. A cluster is named by its smallest core
    point; a border point joins the smallest cluster among its core neighbours, which makes the result
    independent of the order of rows. A core point without neighbours is a cluster of its own or, with
    `lone_is_noise`, noise: so is then every cluster of one point, as where clusters are trees of at least two.

    One pass over the pairs of chunks counts neighbours and finds what hangs together. What comes out of it are neighbours
    of points that its first chunk did not show to be core points, fewer than `min_points` pairs for each point that a unit did
    not show to be one, and a row for each part of a cluster that was joined to another.
    """
    need = min_points - (1 if count_self else 0)
    kind = np.float32 if points.schema[features].dataType.elementType.simpleString() == "float" else float
    chunks = _chunks(points, eps, need, id_col, features, block)
    met = written(_meetings(chunks, eps, need, kind))
    seen = _unpacked(chunks.where("own"), ["ids", "seen", "root"], "id bigint, n bigint, root bigint")
    seen = seen.unionByName(met.where("n is not null").select(F.col("a").alias("id"), "n"), allowMissingColumns=True)
    marked = written(seen.groupBy("id").agg((F.sum("n") >= need).alias("core"), F.max("root").alias("root")))
    pairs = _unpacked(chunks.where("own"), ["a", "b"], "a bigint, b bigint").unionByName(met.where("n is null").select("a", "b"))
    side = lambda c: marked.select(F.col("id").alias(c), F.col("core").alias(f"_core_{c}"), F.col("root").alias(f"_root_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("_core_a or _core_b")
    link = F.when(F.col("_core_a"), F.struct(F.col("_root_a").alias("a"), F.when(F.col("_core_b"), F.col("_root_b")).otherwise(F.col("b")).alias("b")))
    link = link.otherwise(F.struct(F.col("_root_b").alias("a"), F.col("a").alias("b")))
    links = written(pairs.select(link.alias("_l"), (F.col("_core_a") & F.col("_core_b")).alias("solid")).select("_l.a", "_l.b", "solid").where("a <> b").distinct())
    named = few_or_many_components(links.where("solid").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = written(named.select(F.col("node").alias("_node"), F.col("component")))
    cores = marked.where("core").join(named, F.col("root") == F.col("_node"), "left").select("id", F.coalesce("component", "root").alias("cluster"))
    border = links.where("not solid").join(named, F.col("a") == F.col("_node"), "left")
    border = border.groupBy(F.col("b").alias("id")).agg(F.min(F.coalesce("component", "a")).alias("cluster"))
    found = marked.join(cores.unionByName(border), "id", "left").select("id", "cluster", "core")
    if not lone_is_noise:
        return found
    found = written(found)  # read twice
    alone = written(found.where("cluster is not null").groupBy(F.col("cluster").alias("_c")).count().where("count = 1").select("_c"))
    found = found.join(alone, found["cluster"] == alone["_c"], "left")
    return found.select("id", F.when(F.col("_c").isNull(), F.col("cluster")).alias("cluster"), (F.col("core") & F.col("_c").isNull()).alias("core"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Points per cluster; noise is cluster NULL."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("points"), F.count_if("core").alias("cores"))


def nearest_neighbours(points: DataFrame, queries: DataFrame, k: int, id_col: str = "id", features: str = "features", most_bytes: int = 16 << 20) -> DataFrame:
    """(query, id, distance, rank): the k nearest other points of each query point.

    Queries are a stated set against all points: they are taken in blocks of `most_bytes`, each sent to every worker for one pass
    over the points. A task keeps the k nearest of its own points per query, so k rows a query and task are shuffled. Ties
    go to the smaller id.
    """
    found, held, size = None, [], 0
    for q, x in queries.select(id_col, F.transform(features, lambda v: v.cast("double"))).toLocalIterator():
        held.append((q, x))
        size += 8 * len(x) + 8
        if size >= most_bytes:
            part = _nearest(points, held, k, id_col, features)
            found, held, size = part if found is None else found.unionByName(part), [], 0
    if held or found is None:
        part = _nearest(points, held, k, id_col, features)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", F.sqrt("d").alias("distance"), "rank")


def _nearest(points: DataFrame, held: list[tuple[int, list[float]]], k: int, id_col: str, features: str) -> DataFrame:
    """(query, id, d): the k nearest points of a task for each query, with squared distances."""
    sent = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        if not len(ids):
            return
        best = np.full((len(ids), k), np.inf)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            x = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
            step = max(1, (1 << 22) // max(1, len(ids) * q.shape[1]))
            for at in range(0, len(x), step):
                part, names = x[at : at + step], own[at : at + step]
                d = ((q[:, None, :] - part[None, :, :]) ** 2).sum(-1)
                d[ids[:, None] == names[None, :]] = np.inf
                both = np.concatenate([best, d], axis=1)
                name = np.concatenate([who, np.broadcast_to(names, d.shape)], axis=1)
                order = np.lexsort((name, both), axis=1)[:, :k]
                best, who = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(1))), pa.array(who[found]), pa.array(best[found])], names=["query", "id", "d"])

    rows = points.select(F.col(id_col).alias("_id"), F.transform(features, lambda v: v.cast("double")).alias("_x"))
    return rows.mapInArrow(run, "query bigint, id bigint, d double")

"""Where a wheel starts and stops turning, by its angle, in runs of any length.

The steps of the angle's sine are smoothed by a regression tree over the row number: up to five times the best cut of each piece. The
sum of steps between two rows is the difference of their sines, so a cut's gain needs only the row and the ends of its
piece. A round is one pass over (run, row, sine), whose ranges are taken by many tasks, and gives one best cut a piece (the largest gain, the
first among equals, combined before the shuffle); a run's pieces, 32 at most, are one row. What starts and stops is read off the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.plans.lineage import written
from spokeflow.plans.spread import filled, numbered

DEPTH = 5
WINDOW = 15  # steps that stand before and after a start or stop
STILL = 1e-4
GAIN = 1e-12  # a cut that gains less is none
FEW_RUNS = 100_000  # runs whose pieces, a row of some 500 bytes each, go to every task


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def steps(df: DataFrame, angle: str, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Written: run, order, _rn (the row's number from 0), _n (rows of the run) and _s, the sine. A missing angle repeats the one before, a first one is 0.

    Rows that `order` does not tell apart are ordered by their angle.
    """
    value = F.col("_angle")
    rows = df.select(*run, *order, F.nanvl(F.col(angle).cast("double"), F.lit(None).cast("double")).alias("_angle"))
    rows = filled(rows, run, [*order, "_angle"], _last=(value, False))
    rows = numbered(rows.withColumn("_s", F.sin(F.radians(F.coalesce("_last", F.lit(0.0))))).drop("_last"), run, [*order, "_angle"])
    return written(rows.drop("_angle"))


def pieces(rows: DataFrame, run: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """run, _n and `pieces`, an array of (a, b, sa, sb, open) in order: steps a to b - 1, between rows with these sines."""
    names = [f"_run{i}" for i in range(len(run))]
    own = [F.col(c).alias(n) for c, n in zip(run, names)]
    ends = rows.groupBy(*own, "_n").agg(F.max(F.when(F.col("_rn") == 0, F.col("_s"))).alias("sa"), F.max(F.when(F.col("_rn") == F.col("_n") - 1, F.col("_s"))).alias("sb"))
    first = F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("_n") - 1).cast("bigint").alias("b"), "sa", "sb", F.lit(True).alias("open"))
    held = written(ends.select(*names, "_n", F.array(first).alias("pieces")))
    near = F.broadcast if held.count() <= FEW_RUNS else lambda df: df
    for _ in range(depth):
        inside = F.expr("filter(pieces, p -> p.open and p.a < _rn and _rn < p.b)")
        found = rows.join(near(held), _same(run, names)).select(*names, "_rn", "_s", F.get(inside, F.lit(0)).alias("p")).where("p is not null")
        low, high = F.col("_s") - F.col("p.sa"), F.col("p.sb") - F.col("_s")
        gain = low * low / (F.col("_rn") - F.col("p.a")) + high * high / (F.col("p.b") - F.col("_rn"))
        best = found.groupBy(*names, F.col("p.a").alias("a")).agg(F.max(F.struct(gain.alias("gain"), (-F.col("_rn")).alias("at"), F.col("_s").alias("s"))).alias("best"))
        cuts = best.groupBy(*[F.col(n).alias(f"_c{n}") for n in names]).agg(F.map_from_entries(F.collect_list(F.struct("a", "best"))).alias("_cuts"))  # 32 at most
        joined = held.join(cuts, _same(names, [f"_c{n}" for n in names]), "left")
        cut = """flatten(transform(pieces, p -> case
            when p.open and _cuts[p.a] is not null and _cuts[p.a].gain - (p.sb - p.sa) * (p.sb - p.sa) / (p.b - p.a) > %r then array(
                named_struct('a', p.a, 'b', -_cuts[p.a].at, 'sa', p.sa, 'sb', _cuts[p.a].s, 'open', true),
                named_struct('a', -_cuts[p.a].at, 'b', p.b, 'sa', _cuts[p.a].s, 'sb', p.sb, 'open', true))
            else array(named_struct('a', p.a, 'b', p.b, 'sa', p.sa, 'sb', p.sb, 'open', false)) end))""" % GAIN
        held = written(joined.select(*names, "_n", F.expr(cut).alias("pieces")))
    return held.select(*[F.col(n).alias(c) for n, c in zip(names, run)], "_n", "pieces")


def starts_and_stops(cut: DataFrame, run: Sequence[str], window: int = WINDOW, still: float = STILL) -> DataFrame:
    """run, start and stop: the row before a start (`window` still steps, then as many moving ones), and before a stop (the other way round).

    Without a start it is row 0, without a stop the last row.
    """
    fields = ", ".join(f"_r{i} {f.dataType.simpleString()}" for i, f in enumerate(cut.select(*run).schema.fields))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, parts in zip(batch.column(len(run)).to_pylist(), batch.column(len(run) + 1).to_pylist()):
                spans: list[list[int]] = []  # [still or not, a, b], joined
                for p in parts:
                    calm = p["b"] > p["a"] and abs((p["sb"] - p["sa"]) / (p["b"] - p["a"])) < still
                    if spans and spans[-1][0] == calm:
                        spans[-1][2] = p["b"]
                    else:
                        spans.append([calm, p["a"], p["b"]])
                edges = [(x[0], y[1]) for x, y in zip(spans, spans[1:]) if min(x[2] - x[1], y[2] - y[1]) >= window]
                out.append((next((at - 1 for calm, at in edges if calm), 0), next((at - 1 for calm, at in edges if not calm), n - 1)))
            starts, stops = (pa.array([o[i] for o in out], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(run)], starts, stops], names=[*[f"_r{i}" for i in range(len(run))], "start", "stop"])

    rows = cut.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(run)], "_n", "pieces")
    return rows.mapInArrow(find, f"{fields}, start bigint, stop bigint").withColumnsRenamed({f"_r{i}": c for i, c in enumerate(run)})


def turning(df: DataFrame, angle: str, run: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Per run the row numbers, from 0, before a turning wheel first starts and before it first stops."""
    run, order = [run] if isinstance(run, str) else list(run), [order] if isinstance(order, str) else list(order)
    return starts_and_stops(pieces(steps(df, angle, run, order), run), run).select(*run, F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def turning_spans(df: DataFrame, angle: str, run: Sequence[str], order: str) -> DataFrame:
    """Per run the values of `order` at its first start and first stop."""
    run = list(run)
    rows = steps(df, angle, run, [order])
    found = starts_and_stops(pieces(rows, run), run)
    found = found.withColumnsRenamed({c: f"_f{i}" for i, c in enumerate(run)})
    at = rows.join(found, _same(run, [f"_f{i}" for i in range(len(run))]) & ((F.col("_rn") == F.col("start")) | (F.col("_rn") == F.col("stop"))))
    pick = lambda c: F.max(F.when(F.col("_rn") == F.col(c), F.col(order)))
    return at.groupBy(*run).agg(pick("start").alias("_first"), pick("stop").alias("_stop"))

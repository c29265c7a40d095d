"""Features of trailing windows: expressions where windows express them, Arrow batches where they don't."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.functions import arrays
from spokeflow.functions.scalars import feature_name
from spokeflow.functions.windows import TRAIL, frame, trailing, trailing_slope
from spokeflow.operators import signal
from spokeflow.plans.spread import in_pieces

SERIES = list(signal.series_features(np.zeros(8)))
SERIES_PIECE = 1 << 12  # rows of a run that a task takes features of at once


def sink_features(
    df: DataFrame, run: Sequence[str], order: Sequence[str], sink: str = "sink", front: str = "theta_f", rear: str = "theta_r", largest: str = "theta_m", rows: int = TRAIL,
) -> DataFrame:
    """Trailing mean, deviation and slope of the sinkage, mean and deviation of the contact's front angle less its rear one, and mean of the angle of its largest pixel."""
    s, a = F.col(sink), F.col(front) - F.col(rear)
    return df.withColumns({
        "sink_mean": trailing(s, "mean", run, order, rows), "sink_std": trailing(s, "std", run, order, rows),
        "sink_slope": trailing_slope(s, run, order, rows), "sink_diff_angle_mean": trailing(a, "mean", run, order, rows),
        "sink_diff_angle_std": trailing(a, "std", run, order, rows), "sink_theta_m": trailing(F.col(largest), "mean", run, order, rows),
    })


def npix_differences(df: DataFrame, run: Sequence[str], order: Sequence[str], a: str, b: str, skip: Column, rows: int = TRAIL) -> DataFrame:
    """Largest and smallest trailing a - b over rows that are not skipped; none left gives NULL."""
    d = F.when(~skip, F.col(a) - F.col(b))
    return df.withColumns({"npix_max_diff": trailing(d, "max", run, order, rows), "npix_min_diff": trailing(d, "min", run, order, rows)})


def smoothness(df: DataFrame, x: str, run: Sequence[str], order: Sequence[str], rows: int = TRAIL, output: str = "smness") -> DataFrame:
    """Deviation of the steps between the trailing rows."""
    w = Window.partitionBy(*run).orderBy(*order)
    stepped = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    return stepped.withColumn(output, F.stddev_pop("_d").over(frame(run, order, rows - 1, 0))).drop("_d")


def series_columns(x: Column) -> dict[str, Column]:
    """Features of an array<double> that higher-order functions express."""
    out = {f"ratio_beyond_{r}_sigma": arrays.ratio_beyond(x, r) for r in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)}
    out |= {f"quantile_{q}": arrays.quantile(x, q) for q in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)}
    out |= {f"energy_ratio_{i}": arrays.energy_ratio(x, i) for i in range(10)}
    return out | {
        "percentage_of_reoccurring": arrays.reoccurring_share(x), "longest_strike_below_mean": arrays.longest_strike(x, False),
        "longest_strike_above_mean": arrays.longest_strike(x, True), "absolute_sum_of_changes": arrays.sum_of_changes(x),
        "symmetry_looking": arrays.looks_symmetric(x), "change_variance_abs": arrays.change_variance(x, absolute=True),
        "change_variance": arrays.change_variance(x, absolute=False), "variance": arrays.variance(x),
    }


def trailing_series(df: DataFrame, x: str, run: Sequence[str], order: Sequence[str], rows: int = TRAIL, keep: Sequence[str] = (), suffix: str = "", cwt: bool = True) -> DataFrame:
    """SERIES features over the trailing rows of each row: (run.., order.., keep.., features), their names with a suffix.

    A long run is cut into pieces that carry the rows before them, so no task holds a run and each value travels once;
    within a piece the windows of one length are taken together.
    """
    kept = list(dict.fromkeys([*run, *order, *keep]))
    pieces = in_pieces(df.select(*kept, F.col(x).cast("double").alias("_x")), run, order, rows, rows=SERIES_PIECE)
    names = [n + suffix for n in SERIES]
    schema = ", ".join([*(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept), *(f"`{n}` double" for n in names)])

    def of_piece(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        values = np.array(table.column("_x").to_pylist(), object if table.column("_x").null_count else float)
        found = signal.trailing_rows(values, rows, cwt)
        own = table.column("_own")
        found = found[own.to_numpy()]
        return pa.table([*table.filter(own).select(kept).columns, *(pa.array(c, from_pandas=True) for c in found.T)], names=[*kept, *names])

    parts = [*run, "_piece"]
    dealt = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *parts)  # small in bytes, not in work
    return dealt.groupBy(*parts).applyInArrow(of_piece, schema)


def image_features(strips: DataFrame, run: Sequence[str], order: str, lag: str = "lag", row: str = "row", value: str = "p", rows: int = TRAIL) -> DataFrame:
    """Geometry of the images that trailing strips make side by side: (run.., order, lag, PROPERTIES).

    A strip is one frame's pressure column at a lag; an image is rows + 1 strips at most, as shares of the largest
    value of all lags in them. A long run is cut into pieces that carry the strips before them, so no task holds a run and each
    strip travels once; within a piece the images of one width are taken together.
    """
    cell = F.struct(F.col(row).alias("r"), F.col(value).cast("double").alias("v"))
    per = strips.groupBy(*run, order, lag).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("_strip"), F.max(value).cast("double").alias("_max")
    )
    per = per.withColumn("_max", F.max("_max").over(Window.partitionBy(*run, order)))
    kept = [*run, order, lag]
    pieces = in_pieces(per.select(*kept, "_strip", "_max"), [*run, lag], [order], rows, rows=SERIES_PIECE)
    parts = [*run, lag, "_piece"]
    schema = ", ".join([*(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} double" for n in signal.PROPERTIES)])

    def of_piece(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        held = table.column("_strip").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        own = table.column("_own")
        which = np.flatnonzero(own.to_numpy())
        mine = table.filter(own)
        tops = mine.column("_top").to_numpy().astype(float)
        found = signal.trailing_images(held.reshape(table.num_rows, -1), tops, which, rows)
        return pa.table([*mine.select(kept).columns, *map(pa.array, found.T)], names=[*kept, *signal.PROPERTIES])

    w = Window.partitionBy(*parts).orderBy("_rn").rowsBetween(-rows, 0)
    dealt = pieces.repartition(int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions")), *parts)  # small in bytes, not in work
    return dealt.withColumn("_top", F.max("_max").over(w)).groupBy(*parts).applyInArrow(of_piece, schema)


def frame_regions(frames: DataFrame, key: str, frame: str, rows: int, least: int = 10) -> DataFrame:
    """Regions of pixels above a frame's Otsu threshold that have `least` pixels: (key, region, PROPERTIES), from flat arrays of `rows` rows."""
    kind = frames.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}, region int", *(f"{n} double" for n in signal.PROPERTIES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[frame]):
                image = np.asarray(v, float).reshape(rows, -1)
                found = signal.label(image > signal.otsu(image))
                kept = [i for i in range(1, found.max() + 1) if (found == i).sum() >= least]
                out += [(k, n, *signal.region(found == i, image)) for n, i in enumerate(kept)]
            yield pd.DataFrame(out, columns=[key, "region", *signal.PROPERTIES])

    return frames.select(key, frame).mapInPandas(run, schema)


def degroused(frames: DataFrame, key: str, frame: str, rows: int, name: str = "haar", level: int = 3) -> DataFrame:
    """Flat frames rebuilt without the detail that lies along their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [signal.degrouse(np.asarray(v, float).reshape(rows, -1), name, level).ravel() for v in pdf[frame]]
            yield pd.DataFrame({key: pdf[key], frame: images})

    return frames.select(key, frame).mapInPandas(run, f"`{key}` {frames.schema[key].dataType.simpleString()}, `{frame}` array<double>")


def named_features(features: DataFrame, keys: Sequence[str], names: Sequence[str], subset: str, lags: Sequence[int], number: int | None = None) -> DataFrame:
    """Features per lag, such as `image_features` and `unwrap_features` give, side by side under their published names."""
    cells = [F.max(F.when(F.col("lag") == l, F.col(n))).alias(feature_name(n, subset, l, number)) for n in names for l in lags]
    return features.groupBy(*keys).agg(*cells)


def rotations(df: DataFrame, angle: str, run: Sequence[str], order: Sequence[str], distance: float = 200.0, circumference: float = 165.0) -> DataFrame:
    """Per run its number of turns and mean slip: gaps of over 100 rows between rows at 360 are whole turns."""
    w = Window.partitionBy(*run).orderBy(*order)
    a = F.ceil(F.col(angle)).cast("long")
    rows = df.select(*run, *order, a.alias("_a"), F.row_number().over(w).alias("_i"))
    rows = rows.withColumn("_p", F.max(F.when(F.col("_a") == 360, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    full = F.count_if((F.col("_a") == 360) & (F.col("_i") - F.col("_p") > 100))
    first, last = F.min_by("_a", "_i"), F.max_by("_a", "_i")
    out = rows.groupBy(*run).agg((full + (360.0 - first + last) / 360.0).alias("n_rot"))
    return out.withColumn("mean_slip", 1 - F.least(F.try_divide(F.lit(distance), F.col("n_rot") * circumference), F.lit(1.0)))

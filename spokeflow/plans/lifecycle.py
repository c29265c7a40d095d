"""Runs -> bins -> contact -> features -> labels -> model, each step a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.functions.scalars import AMBIGUOUS, contact_column
from spokeflow.operators import assemble, binning, frames, masks, series
from spokeflow.plans.lineage import written
from spokeflow.plans.spread import in_pieces, owned


def unify(samples: DataFrame, run: str = "run_id", width: float = 0.1, angle: str = "rho", values: Sequence[str] = ("slip", "sink", "current")) -> DataFrame:
    """(run, channel, ts, value) onto the run's grid: angle by circular mean, others by mean where they exist."""
    angles = samples.where(F.col("channel") == angle)
    edges = binning.grid(angles, "ts", [run], width)
    rows = binning.on_grid(samples, edges, "ts", [run], width)
    turned = binning.bin_angles(rows.where(F.col("channel") == angle), [run], "value", angle)
    others = [binning.bin_means(rows.where(F.col("channel") == v), [run], ["value"]).withColumnRenamed("value", v) for v in values]
    return binning.align([turned], others, [run, "bin"]).withColumn("imu_bin", contact_column(F.col(angle)))


def featurise(binned: DataFrame, pixels: DataFrame, run: str = "run_id", low: int = 0, angle: str = "rho") -> DataFrame:
    """Contact, sinkage and trailing features of moving rows; pixels are (run, bin, row, col, p).

    A run whose current channel is dead is cut to where its angle turns. Rows whose hub column is ambiguous don't count in
    the trailing differences of contact pixels.
    """
    moving = masks.burn_in(masks.moving(binned, "current", [run], angle, "bin"), [run], ["bin"], low)
    cells = pixels.join(moving.select(run, "bin", "t", "imu_bin"), [run, "bin"])
    keys = [run, "t"]
    marked = written(frames.contact(cells, keys, "imu_bin"))  # three aggregates read it
    out = moving.withColumn("rot_angle", F.col(angle))
    depth = frames.sink_depth(marked.drop("sink"), keys, "imu_bin").withColumnRenamed("sink", "wheel_sink")
    for part in (frames.contact_area(marked, keys), frames.geometry(marked, keys, "imu_bin"), depth):
        out = out.join(part, keys, "left")
    rows = in_pieces(out, [run], ["t"], series.TRAIL)
    within = [run, "_piece"], ["_rn"]
    rows = series.sink_features(rows, *within, sink="wheel_sink")
    return owned(series.npix_differences(rows, *within, "npix_grouser", "npix_nongrouser", F.col("imu_bin").isin(AMBIGUOUS)))


def training_table(features: Sequence[DataFrame], names: Sequence[str], label: str, order: Sequence[str] = ()) -> DataFrame:
    """Runs stacked by name, without rows that hold a missing number; with an `order` also without outliers of a continuous label."""
    rows = assemble.stacked(features)
    return masks.trainable_rows(rows, names, label, order) if order else masks.finite_rows(rows, names, label)

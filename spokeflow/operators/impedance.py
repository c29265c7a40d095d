"""Features of impedance sweeps held as arrays re, im and freq."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.functions.scalars import amplitude, phase
from spokeflow.functions.windows import TRAIL, trailing


def nearest_index(freq: Column, target: float) -> Column:
    """Position, from 0, of the frequency nearest to `target`; the first on ties, NULL without any."""
    far = F.transform(freq, lambda f, i: F.struct(F.abs(f - F.lit(target)).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def at_frequency(df: DataFrame, targets: Sequence[float], re: str = "re", im: str = "im", freq: str = "freq") -> DataFrame:
    """Adds amplitude_<n> and phase_<n> at the frequency nearest to each target."""
    out = df
    for n, target in enumerate(targets):
        out = out.withColumn("_i", nearest_index(F.col(freq), target))
        a, b = F.get(re, F.col("_i")), F.get(im, F.col("_i"))
        out = out.withColumns({f"amplitude_{n}": amplitude(a, b), f"phase_{n}": phase(a, b)})
    return out.drop("_i")


def sweep_features(df: DataFrame, targets: Sequence[float], run: Sequence[str], order: Sequence[str], rows: int = TRAIL, **columns: str) -> DataFrame:
    """Trailing means of amplitude and phase at the frequencies nearest to the targets."""
    out = at_frequency(df, targets, **columns)
    names = [f"{kind}_{n}" for n in range(len(targets)) for kind in ("amplitude", "phase")]
    return out.withColumns({f"{c}_mean": trailing(F.col(c), "mean", run, order, rows) for c in names})

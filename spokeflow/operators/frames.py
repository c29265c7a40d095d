"""Pressure frames as cells (run.., t, row, col, p): calibration, contact areas and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeflow.functions.scalars import AMBIGUOUS, BELT_MM, COLUMNS, RADIUS_MM, ROWS, contact_column, signed_lag, sinkage
from spokeflow.plans.quantiles import quantiles

SUBSETS = ["all", "grouser", "nongrouser"]


def cells(frames: DataFrame, keys: Sequence[str], frame: str, columns: int = COLUMNS) -> DataFrame:
    """One row per pixel of a frame held as a flat array in row order."""
    out = frames.select(*keys, F.posexplode(frame).alias("_at", "p"))
    return out.select(*keys, F.expr(f"_at div {columns}").cast("int").alias("row"), (F.col("_at") % columns).alias("col"), F.col("p").cast("double").alias("p"))


def frames(pixels: DataFrame, keys: Sequence[str], value: str = "p", columns: int = COLUMNS) -> DataFrame:
    """Back to flat arrays in row order."""
    at = F.struct((F.col("row") * columns + F.col("col")).alias("at"), F.col(value).alias("v"))
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["v"]).alias("frame"))


def calibration(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each pixel over all frames."""
    return pixels.groupBy(*keys, "row", "col").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def calibrated(pixels: DataFrame, cal: DataFrame, keys: Sequence[str] = (), turned: bool = False, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """p becomes -(p - mean) / std. `turned` compares a pixel with its opposite, as stored calibrations are turned."""
    if turned:
        cal = cal.withColumns({"row": rows - 1 - F.col("row"), "col": columns - 1 - F.col("col")})
    out = pixels.join(cal, [*keys, "row", "col"])
    return out.withColumn("p", F.try_divide(-(F.col("p") - F.col("mean")), F.col("std"))).drop("mean", "std")


def without_drift(pixels: DataFrame, run: Sequence[str]) -> DataFrame:
    """p less the pixel's median over the run: an aggregate of one row per pixel, joined back."""
    drift = quantiles(pixels, [*run, "row", "col"], {"_m": "p"}, [0.5]).withColumn("_median", F.col("_m")[0]).drop("_m")
    return pixels.join(drift, [*run, "row", "col"]).withColumn("p", F.col("p") - F.col("_median")).drop("_median")


def neighbours(rows: int, columns: int, bad: int, most: int = 9, reach: float = 2.0) -> list[tuple[int, int, int]]:
    """(row, neighbour row, neighbour column): pixels nearer than `reach` in other columns, the nearest `most`."""
    out = []
    for r in range(rows):
        near = sorted(
            (((r - y) ** 2 + (bad - x) ** 2) ** 0.5, y, x) for y in range(rows) for x in range(columns) if abs(r - y) <= reach and abs(bad - x) <= reach
        )
        out += [(r, y, x) for d, y, x in near[:most] if d < reach and x != bad]
    return out


def imputed(pixels: DataFrame, keys: Sequence[str], bad: int = 23, rows: int = ROWS, columns: int = COLUMNS, when: Column | None = None) -> DataFrame:
    """The bad column takes the mean of its neighbours in other columns (in frames for which `when` holds).

    The neighbour table is static and under 200 rows; only the columns beside the bad one meet it.
    """
    spark = pixels.sparkSession
    near = spark.createDataFrame(neighbours(rows, columns, bad), "to int, row int, col int")
    use = F.lit(True) if when is None else when
    beside = pixels.where(use & F.col("col").between(bad - 2, bad + 2)).join(F.broadcast(near), ["row", "col"])
    mean = beside.groupBy(*keys, "to").agg(F.avg("p").alias("_p")).select(*keys, F.col("to").alias("row"), F.lit(bad).alias("col"), "_p")
    out = pixels.join(mean, [*keys, "row", "col"], "left")
    return out.withColumn("p", F.coalesce("_p", "p")).drop("_p")


def contact(pixels: DataFrame, keys: Sequence[str], hub: str, columns: int = COLUMNS, multiple: float = 3.0, reach: int = 5) -> DataFrame:
    """Adds subset, lag and in_contact: p at or above q3 + multiple * (q3 - q1) of its frame's subset, near the hub.

    `hub` is the column under the hub. Grousers are the even columns.
    """
    rows = pixels.withColumn("subset", F.when(F.col("col") % 2 == 0, "grouser").otherwise("nongrouser"))
    w = Window.partitionBy(*keys, "subset")
    q1, q3 = F.percentile("p", F.lit(0.25)).over(w), F.percentile("p", F.lit(0.75)).over(w)
    lag = signed_lag(F.col("col"), F.col(hub), columns)
    return rows.withColumns({"lag": lag, "in_contact": (F.col("p") >= q3 + multiple * (q3 - q1)) & (F.abs(lag) <= reach)})


def contact_area(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame the number of contact pixels of all, grouser and nongrouser columns, and if any is ambiguous."""
    hit = F.col("in_contact")
    npix = lambda k: F.count_if(hit & (F.col("subset") == k))
    return marked.groupBy(*keys).agg(
        F.count_if(hit).alias("npix_all"), npix("grouser").alias("npix_grouser"), npix("nongrouser").alias("npix_nongrouser"),
        F.bool_or(hit & F.col("col").isin(AMBIGUOUS)).alias("ambiguous"),
    )


def contact_sets(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame and subset its ragged contact: npix, coords, values and the values out of contact."""
    both = marked.unionByName(marked.withColumn("subset", F.lit("all")))
    cell = F.struct("row", "col", "p")
    own = both.groupBy(*keys, "subset").agg(
        F.array_sort(F.collect_list(F.when(F.col("in_contact"), cell))).alias("_in"), F.array_sort(F.collect_list(F.when(~F.col("in_contact"), cell))).alias("_out")
    )
    return own.select(
        *keys, "subset", F.size("_in").alias("npix"), F.transform("_in", lambda c: F.struct(c["row"], c["col"])).alias("coords"),
        F.transform("_in", lambda c: c["p"]).alias("values"), F.transform("_out", lambda c: c["p"]).alias("noncontact"),
        F.exists("_in", lambda c: c["col"].isin(AMBIGUOUS)).alias("ambiguous"),
    )


def contact_statistics(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of contact pixels as shares of the frame's largest value; kurtosis is excess, none gives NULLs."""
    top = F.max("p").over(Window.partitionBy(*keys))
    x = F.when(F.col("in_contact"), F.try_divide(F.col("p"), F.col("_top")))
    return marked.withColumn("_top", top).groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis")
    )


def geometry(marked: DataFrame, keys: Sequence[str], hub: str, columns: int = COLUMNS) -> DataFrame:
    """area_ratio (an empty side counts 0.01), row_wheel_ratio and maxcol_imu_diff."""
    hit, col, at = F.col("in_contact"), F.col("col"), F.col(hub)
    front, back = F.count_if(hit & (col < at)), F.count_if(hit & (col > at))
    some = lambda n: F.when(n == 0, F.lit(0.01)).otherwise(n.cast("double"))
    top = F.max_by("lag", F.struct(F.col("p"), -col))  # the first column that holds the largest pixel
    return marked.groupBy(*keys).agg(
        (some(front) / some(back)).alias("area_ratio"), (F.count_distinct(F.when(hit, col)) / columns).alias("row_wheel_ratio"), (-top).alias("maxcol_imu_diff")
    )


def sink_depth(marked: DataFrame, keys: Sequence[str], hub: str, column_mm: float = BELT_MM / COLUMNS, radius: float = RADIUS_MM) -> DataFrame:
    """sink from the number of contact columns at or after the hub, the angles theta_f and theta_r that the contact takes up
    there and before the hub, and theta_m of the largest contact pixel; all zero without contact."""
    hit, col = F.col("in_contact"), F.col("col")
    columns = lambda side: F.count_distinct(F.when(hit & side, col))
    out = marked.groupBy(*keys).agg(
        columns(col >= F.col(hub)).alias("_front"), columns(col < F.col(hub)).alias("_rear"), F.first(hub).alias("_hub"),
        F.max_by("col", F.when(hit, F.struct(F.col("p"), -F.col("row"), -col))).alias("_col"),
    )
    angle = lambda n: n * column_mm / radius
    return out.select(
        *keys, sinkage(F.col("_front"), radius, column_mm).alias("sink"), angle(F.col("_front")).alias("theta_f"), angle(F.col("_rear")).alias("theta_r"),
        F.coalesce(angle(F.col("_hub") - F.col("_col")), F.lit(0.0)).alias("theta_m"),
    )


def sharp(marked: DataFrame, keys: Sequence[str], pixels: int = 15, extreme: int = 4, level: float = 80.0) -> DataFrame:
    """A small contact with few pixels over its 95th percentile whose mean exceeds a level."""
    x = F.when(F.col("in_contact"), F.col("p"))
    rows = marked.withColumn("_x", x).withColumn("_p95", F.percentile("_x", F.lit(0.95)).over(Window.partitionBy(*keys)))
    high = F.when(F.col("_x") > F.col("_p95"), F.col("_x"))
    return rows.groupBy(*keys).agg(
        F.coalesce((F.count("_x") < pixels) & (F.count(high) <= extreme) & (F.avg(high) > level), F.lit(False)).alias("sharp")
    )


def lean(marked: DataFrame, keys: Sequence[str], intended: bool = False, quarter: int = 5, quarters: int = 4) -> DataFrame:
    """1 left, -1 right, 0 neither, by the share of contact in quarters of the rows.

    The rule as published never leaves 0 (it compares a tuple with a number); `intended` applies what its
    text says: the outermost quarter holds under 2 / width of the pixels it could.
    """
    hit = F.col("in_contact")
    width = F.max(F.when(hit, F.col("col"))) - F.min(F.when(hit, F.col("col"))) + 1
    n = [F.count_if(hit & (F.expr(f"row div {quarter}") == q)) for q in range(quarters)]
    out = marked.groupBy(*keys).agg(width.alias("_w"), n[0].alias("_l"), n[-1].alias("_r"))
    if not intended:
        return out.select(*keys, F.lit(0).alias("lean"))
    small = lambda c: F.col(c) / (F.col("_w") * float(quarter)) < 2 / F.col("_w")
    return out.select(*keys, F.when(F.col("_w").isNull(), 0).when(small("_l"), 1).when(small("_r"), -1).otherwise(0).alias("lean"))


def unwrapped(pixels: DataFrame, keys: Sequence[str], hub: str, lags: Sequence[int], subset: str = "all", columns: int = COLUMNS, as_published: bool = False) -> DataFrame:
    """Per frame and lag the pressure column that lies `lag` behind the hub (twice that in a subset, whose columns alternate).

    Frames whose hub column is not of the subset are dropped. A subset ending in `_noamb` also leaves out frames whose hub column
    is ambiguous. `as_published` takes the hub's column number for an angle in degrees, as the published means and deviations do.
    """
    if as_published:
        pixels = pixels.withColumn(hub, contact_column(F.col(hub), columns))
    if subset.endswith("_noamb"):
        pixels = pixels.where(~F.col(hub).isin(AMBIGUOUS))
        subset = subset.removesuffix("_noamb")
    step = 1 if subset == "all" else 2
    rows = pixels if subset == "all" else pixels.where(F.col(hub) % 2 == (0 if subset.startswith("grouser") else 1))
    at = F.explode(F.array(*[F.struct(F.lit(l).alias("lag"), F.pmod(F.col(hub) - step * l, F.lit(columns)).alias("want")) for l in lags]))
    rows = rows.select(*keys, "row", "col", "p", at.alias("at")).where("col = at.want")
    return rows.select(*keys, F.col("at.lag").alias("lag"), "row", "p")


def unwrap_features(strips: DataFrame, run: Sequence[str], order: str, rows: int = 200) -> DataFrame:
    """Trailing mean and deviation per lag of unwrapped pressure, as shares of the largest value of all lags."""
    per = strips.groupBy(*run, order, "lag").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("p").alias("n"), F.max("p").alias("m"))
    # every lag has the same frames, so the trailing maximum over lags is the maximum of per-frame maxima
    top = F.max("m").over(Window.partitionBy(*run, order))
    per = per.withColumn("m", top)
    w = Window.partitionBy(*run, "lag").orderBy(order).rowsBetween(-rows, 0)
    s, q, n, m = F.sum("s").over(w), F.sum("q").over(w), F.sum("n").over(w), F.max("m").over(w)
    var = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    return per.select(*run, order, "lag", F.try_divide(s / n, m).alias("unwrap_mean"), F.try_divide(F.sqrt(var), m).alias("unwrap_std"))


def extremes(pixels: DataFrame, keys: Sequence[str], along: str = "col") -> DataFrame:
    """The largest pixel of each column (or row) of a frame."""
    return pixels.groupBy(*keys, along).agg(F.max("p").alias("top"))


def frame_percentiles(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = [0.0, 0.05, 0.25, 0.75, 0.95, 1.0]
    p = F.percentile("p", F.array(*[F.lit(x) for x in q]))
    return pixels.groupBy(*keys).agg(p.alias("_q")).select(*keys, *[F.col("_q")[i].alias(f"p{int(100 * x)}") for i, x in enumerate(q)])

"""Pressure-frame operators on embeddings read as small grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from spokeflow.operators import frames, series
from spokeflow.queries import PX, pixels, query, r6, rounded

_KEYS = ["t", "hub"]
_MARKED = f"""q AS (SELECT t, col % 2 AS odd, quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM {PX} GROUP BY ALL),
m AS (SELECT x.*, ((x.col - hub + 8) % 16 + 16) % 16 - 8 AS lag, p >= b + 0.5 * (b - a) AND abs(((x.col - hub + 8) % 16 + 16) % 16 - 8) <= 5 AS hit FROM {PX} x JOIN q ON x.t = q.t AND x.col % 2 = q.odd)"""


def _marked(spark, sf):
    return frames.contact(pixels(spark, sf), ["run", "t"], "hub", columns=16, multiple=0.5)


@query(f"""SELECT "row", col, round(avg(p), 6) + 0.0 AS mean, round(stddev_pop(p), 6) AS std FROM {PX} GROUP BY 1, 2""")
def frame_calibration(spark, sf):
    return rounded(frames.calibration(pixels(spark, sf)), "mean", "std")


@query(f"""WITH c AS (SELECT "row", col, avg(p) AS mean, stddev_pop(p) AS std FROM {PX} GROUP BY 1, 2)
SELECT x.t, x."row", x.col, round(-(p - mean) / nullif(std, 0), 6) + 0.0 AS p FROM {PX} x JOIN c ON x."row" = 3 - c."row" AND x.col = 15 - c.col""")
def frame_zscore(spark, sf):
    px = pixels(spark, sf)
    z = frames.calibrated(px, frames.calibration(px), turned=True, rows=4, columns=16)
    return z.select("t", "row", "col", r6("p").alias("p"))


@query(f"""SELECT t, "row", col, round(p - median(p) OVER (PARTITION BY run, "row", col), 6) + 0.0 AS p FROM {PX}""")
def frame_drift(spark, sf):
    return frames.without_drift(pixels(spark, sf), ["run"]).select("t", "row", "col", r6("p").alias("p"))


@query(f"""SELECT x.t, x."row", x.col, round(CASE WHEN x.col = 5 THEN (SELECT avg(y.p) FROM {PX} y WHERE y.t = x.t AND abs(y."row" - x."row") <= 1 AND y.col IN (4, 6)) ELSE x.p END, 6) + 0.0 AS p FROM {PX} x""")
def frame_imputation(spark, sf):
    out = frames.imputed(pixels(spark, sf), ["run", "t", "hub"], bad=5, rows=4, columns=16)
    return out.select("t", "row", "col", r6("p").alias("p"))


@query(f"WITH {_MARKED} SELECT t, count(CASE WHEN hit THEN 1 END) AS npix_all, count(CASE WHEN hit AND col % 2 = 0 THEN 1 END) AS npix_grouser, count(CASE WHEN hit AND col % 2 = 1 THEN 1 END) AS npix_nongrouser, bool_or(hit AND col < 5) AS ambiguous FROM m GROUP BY 1")
def contact_area(spark, sf):
    return frames.contact_area(_marked(spark, sf), ["t"])


@query(f"""WITH {_MARKED}, s AS (SELECT *, CASE WHEN col % 2 = 0 THEN 'grouser' ELSE 'nongrouser' END AS subset FROM m UNION ALL SELECT *, 'all' FROM m)
SELECT t, subset, count(CASE WHEN hit THEN 1 END)::INT AS npix, round(coalesce(sum(CASE WHEN hit THEN p END), 0), 6) + 0.0 AS total, count(CASE WHEN NOT hit THEN 1 END)::INT AS n_out FROM s GROUP BY ALL""")
def contact_sets(spark, sf):
    out = frames.contact_sets(_marked(spark, sf), ["t"])
    return out.select("t", "subset", "npix", r6(F.aggregate("values", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.size("noncontact").alias("n_out"))


@query(f"""WITH {_MARKED}, x AS (SELECT t, CASE WHEN hit THEN p / nullif(max(p) OVER (PARTITION BY t), 0) END AS x FROM m), c AS (SELECT t, avg(x) AS mu FROM x GROUP BY 1)
SELECT x.t, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(max(x), 6) + 0.0 AS max, round(min(x), 6) + 0.0 AS min, round(CASE WHEN stddev_pop(x) > 1e-9 THEN avg((x - mu) ** 3) / stddev_pop(x) ** 3 END, 5) + 0.0 AS skew,
round(CASE WHEN stddev_pop(x) > 1e-9 THEN avg((x - mu) ** 4) / var_pop(x) ** 2 - 3 END, 4) + 0.0 AS kurtosis FROM x JOIN c USING (t) GROUP BY 1""")
def contact_statistics(spark, sf):
    out = frames.contact_statistics(_marked(spark, sf), ["t"])
    real = lambda c, digits: (F.round(F.when(F.col("std") > 1e-9, F.col(c)), digits) + 0.0).alias(c)
    return rounded(out.select("t", "mean", "std", "max", "min", real("skew", 5), real("kurtosis", 4)), "mean", "std", "max", "min")


@query(f"""WITH {_MARKED}, c AS (SELECT t, col, lag, max(p) AS p FROM m GROUP BY ALL)
SELECT m.t, round((CASE WHEN count(CASE WHEN hit AND col < hub THEN 1 END) = 0 THEN 0.01 ELSE count(CASE WHEN hit AND col < hub THEN 1 END) END)::DOUBLE / (CASE WHEN count(CASE WHEN hit AND col > hub THEN 1 END) = 0 THEN 0.01 ELSE count(CASE WHEN hit AND col > hub THEN 1 END) END)::DOUBLE, 6) AS area_ratio,
round(count(DISTINCT CASE WHEN hit THEN col END) / 16, 6) + 0.0 AS row_wheel_ratio, -any_value(l.lag) AS maxcol_imu_diff FROM m JOIN (SELECT t, arg_max(lag, (p, -col)) AS lag FROM c GROUP BY 1) l USING (t) GROUP BY 1""")
def contact_geometry(spark, sf):
    return rounded(frames.geometry(_marked(spark, sf), ["t"], "hub", 16), "area_ratio", "row_wheel_ratio")


@query(f"""WITH {_MARKED}, s AS (SELECT t, any_value(hub) AS hub, count(DISTINCT CASE WHEN hit AND col >= hub THEN col END) AS n, count(DISTINCT CASE WHEN hit AND col < hub THEN col END) AS r, arg_max(col, (p, -"row", -col)) FILTER (hit) AS top FROM m GROUP BY 1)
SELECT t, round(CASE WHEN n > 0 THEN 254.5 * (cos(n * (1598.0::DOUBLE / 96) / 254.5) - 1) ELSE 0 END, 6) + 0.0 AS sink, round(n * (1598.0::DOUBLE / 96) / 254.5, 6) + 0.0 AS theta_f, round(r * (1598.0::DOUBLE / 96) / 254.5, 6) + 0.0 AS theta_r,
round(coalesce((1598.0::DOUBLE / 96) * (hub - top) / 254.5, 0), 6) + 0.0 AS theta_m FROM s""")
def wheel_sinkage(spark, sf):
    return rounded(frames.sink_depth(_marked(spark, sf), ["t"], "hub"), "sink", "theta_f", "theta_r", "theta_m")


@query(f"""WITH {_MARKED}, h AS (SELECT t, quantile_cont(CASE WHEN hit THEN p END, 0.95) AS p95 FROM m GROUP BY 1)
SELECT m.t, coalesce(count(CASE WHEN hit THEN 1 END) < 15 AND count(CASE WHEN hit AND p > p95 THEN 1 END) <= 4 AND avg(CASE WHEN hit AND p > p95 THEN p END) > 200, false) AS sharp FROM m JOIN h USING (t) GROUP BY 1""")
def sharp_contacts(spark, sf):
    return frames.sharp(_marked(spark, sf), ["t"], level=200.0)


@query(f"""WITH {_MARKED}, w AS (SELECT t, max(CASE WHEN hit THEN col END) - min(CASE WHEN hit THEN col END) + 1 AS w, count(CASE WHEN hit AND "row" = 0 THEN 1 END) AS l, count(CASE WHEN hit AND "row" = 3 THEN 1 END) AS r FROM m GROUP BY 1)
SELECT t, 0 AS published, CASE WHEN w IS NULL THEN 0 WHEN l / (w * 1.0) < 2.0 / w THEN 1 WHEN r / (w * 1.0) < 2.0 / w THEN -1 ELSE 0 END AS intended FROM w""")
def wheel_lean(spark, sf):
    m = _marked(spark, sf)
    a = frames.lean(m, ["t"]).withColumnRenamed("lean", "published")
    return a.join(frames.lean(m, ["t"], intended=True, quarter=1).withColumnRenamed("lean", "intended"), "t")


@query(f"""SELECT x.t, l.l AS lag, x."row", round(p, 6) + 0.0 AS p FROM {PX} x, (VALUES (0), (1), (3)) l(l) WHERE hub % 2 = 0 AND col = ((hub - 2 * l.l) % 16 + 16) % 16""")
def unwrapped_strips(spark, sf):
    out = frames.unwrapped(pixels(spark, sf), ["t", "hub"], "hub", [0, 1, 3], "grouser", 16)
    return out.select("t", "lag", "row", r6("p").alias("p"))


@query(f"""WITH s AS (SELECT run, x.t, l.l AS lag, p FROM {PX} x, (VALUES (0), (1)) l(l) WHERE col = ((hub - l.l) % 16 + 16) % 16),
f AS (SELECT run, t, lag, sum(p) AS s, sum(p * p) AS q, count(*) AS n, max(p) AS m0 FROM s GROUP BY ALL), g AS (SELECT *, max(m0) OVER (PARTITION BY run, t) AS m FROM f),
w AS (SELECT run, t, lag, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n, max(m) OVER w AS m FROM g WINDOW w AS (PARTITION BY run, lag ORDER BY t ROWS BETWEEN 200 PRECEDING AND CURRENT ROW))
SELECT run, t, lag, round(s / n / nullif(m, 0), 6) + 0.0 AS unwrap_mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)) / nullif(m, 0), 6) + 0.0 AS unwrap_std FROM w""")
def unwrap_features(spark, sf):
    strips = frames.unwrapped(pixels(spark, sf), ["run", "t", "hub"], "hub", [0, 1], "all", 16)
    return rounded(frames.unwrap_features(strips, ["run"], "t"), "unwrap_mean", "unwrap_std")


@query(f"""SELECT t, round(quantile_cont(p, 0.0), 6) + 0.0 AS p0, round(quantile_cont(p, 0.05), 6) + 0.0 AS p5, round(quantile_cont(p, 0.25), 6) + 0.0 AS p25, round(quantile_cont(p, 0.75), 6) + 0.0 AS p75,
round(quantile_cont(p, 0.95), 6) + 0.0 AS p95, round(quantile_cont(p, 1.0), 6) + 0.0 AS p100 FROM {PX} GROUP BY 1""")
def frame_percentiles(spark, sf):
    return rounded(frames.frame_percentiles(pixels(spark, sf), ["t"]), "p0", "p5", "p25", "p75", "p95", "p100")


@query(f"SELECT t, col, round(max(p), 6) + 0.0 AS top FROM {PX} GROUP BY ALL")
def frame_column_maxima(spark, sf):
    return rounded(frames.extremes(pixels(spark, sf), ["t"]), "top")


@query(f"SELECT t, 'x' || len(list(p)) AS size, round(list_sum(list(p)), 6) + 0.0 AS total FROM {PX} GROUP BY 1")
def frame_arrays(spark, sf):
    out = frames.frames(pixels(spark, sf), ["t"], columns=16)
    return out.select("t", F.concat(F.lit("x"), F.size("frame")).alias("size"), r6(F.aggregate("frame", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query()
def image_geometry(spark, sf):
    """Region properties have no SQL form."""
    strips = frames.unwrapped(pixels(spark, sf), ["run", "t", "hub"], "hub", [0, 1], "all", 16)
    return series.image_features(strips, ["run"], "t")


_OTSU = f"""r AS (SELECT t, min(p) AS lo, max(p) AS hi FROM {PX} GROUP BY 1),
b AS (SELECT x.t, least(floor((x.p - lo) / (hi - lo) * 256), 255) AS k, lo, hi FROM {PX} x JOIN r USING (t)), c AS (SELECT t, k, count(*) AS n, lo + (k + 0.5) * (hi - lo) / 256 AS mid FROM b GROUP BY t, k, lo, hi),
w AS (SELECT t, k, mid, sum(n) OVER a AS w1, sum(n * mid) OVER a AS s1, sum(n) OVER (PARTITION BY t) AS w, sum(n * mid) OVER (PARTITION BY t) AS s FROM c WINDOW a AS (PARTITION BY t ORDER BY k ROWS UNBOUNDED PRECEDING)),
o AS (SELECT t, arg_max(k, w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ** 2) AS k FROM w WHERE w1 < w GROUP BY 1),
mask AS (SELECT x.t, x."row", x.col, x.p FROM {PX} x JOIN r USING (t) JOIN o USING (t) WHERE least(floor((x.p - lo) / (hi - lo) * 256), 255) > o.k)"""


@query(f"WITH {_OTSU} SELECT t, count(*) AS n, round(sum(p), 6) + 0.0 AS total FROM mask GROUP BY 1")
def otsu_pixels(spark, sf):
    """Pixels above the Otsu threshold of their frame: those of the histogram's bins above the best cut."""
    from spokeflow.operators import signal

    threshold = F.pandas_udf(lambda s: s.map(lambda v: signal.otsu(v)), "double")
    flat = frames.frames(pixels(spark, sf), ["t"], columns=16).withColumn("cut", threshold("frame"))
    # the threshold is a bin's middle: the pixels of that bin itself lie on its lower side
    lo, hi = F.array_min("frame"), F.array_max("frame")
    place = lambda v: F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256), F.lit(255))
    rows = flat.withColumns({"lo": lo, "hi": hi}).select("t", "lo", "hi", "cut", F.explode("frame").alias("p"))
    return rows.where(place(F.col("p")) > place(F.col("cut"))).groupBy("t").agg(F.count("*").alias("n"), r6(F.sum("p")).alias("total"))


@query(f"""WITH RECURSIVE {_OTSU.replace('mask AS', 'px AS')}, threshold AS (SELECT t, lo + (k + 0.5) * (hi - lo) / 256 AS cut FROM o JOIN r USING (t)),
mask AS (SELECT x.t, x."row" * 16 + x.col AS id, x."row" AS y, x.col AS x, x.p FROM {PX} x JOIN threshold USING (t) WHERE x.p > cut),
g AS (SELECT t, id, id AS reach FROM mask UNION SELECT g.t, g.id, n.id FROM g JOIN mask m ON m.t = g.t AND m.id = g.reach JOIN mask n ON n.t = g.t AND abs(n.y - m.y) + abs(n.x - m.x) = 1),
k AS (SELECT t, id, min(reach) AS part FROM g GROUP BY 1, 2)
SELECT t, count(*)::DOUBLE AS area, round(max(p), 6) + 0.0 AS max_intensity, round(min(p), 6) + 0.0 AS min_intensity, round(avg(p), 6) + 0.0 AS mean_intensity,
round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1))::DOUBLE, 6) AS extent, round(sqrt(4 * count(*) / pi()), 6) AS equivalent_diameter FROM k JOIN mask USING (t, id) GROUP BY t, part HAVING count(*) >= 3""")
def image_regions(spark, sf):
    """Regions of three pixels or more above the threshold."""
    flat = frames.frames(pixels(spark, sf), ["t"], columns=16)
    names = ["area", "max_intensity", "min_intensity", "mean_intensity", "extent", "equivalent_diameter"]
    return series.frame_regions(flat, "t", "frame", 4, 3).select("t", *[r6(n).alias(n) for n in names])


@query(f"""WITH b AS (SELECT *, "row" // 2 AS y, col // 2 AS x, CASE WHEN col % 2 = 0 THEN 1 ELSE -1 END AS s FROM {PX})
SELECT t, "row" * 16 + col AS at, round(p - s * sum(s * p) OVER (PARTITION BY t, y, x) / 4, 6) + 0.0 AS p FROM b""")
def degroused_frames(spark, sf):
    """One level of the wavelet transform, rebuilt without its detail along rows."""
    out = series.degroused(frames.frames(pixels(spark, sf), ["t"], columns=16), "t", "frame", 4, "haar", 1)
    return out.select("t", F.posexplode("frame").alias("at", "p")).select("t", "at", r6("p").alias("p"))


@query(f"""WITH s AS (SELECT run, x.t, l.l AS lag, p FROM {PX} x, (VALUES (-1), (0), (2)) l(l) WHERE hub % 2 = 0 AND hub NOT IN (0, 1, 2, 3, 4) AND col = ((hub - 2 * l.l) % 16 + 16) % 16),
f AS (SELECT run, t, lag, sum(p) AS s, count(*) AS n, max(p) AS m0 FROM s GROUP BY ALL), g AS (SELECT *, max(m0) OVER (PARTITION BY run, t) AS m FROM f),
w AS (SELECT run, t, lag, sum(s) OVER w / sum(n) OVER w / nullif(max(m) OVER w, 0) AS v FROM g WINDOW w AS (PARTITION BY run, lag ORDER BY t ROWS BETWEEN 200 PRECEDING AND CURRENT ROW))
SELECT run, t, round(max(CASE WHEN lag = -1 THEN v END), 6) + 0.0 AS "unwrap_mean-1_grouser", round(max(CASE WHEN lag = 0 THEN v END), 6) + 0.0 AS unwrap_mean0_grouser, round(max(CASE WHEN lag = 2 THEN v END), 6) + 0.0 AS unwrap_mean2_grouser FROM w GROUP BY 1, 2""")
def named_unwrap_features(spark, sf):
    """Per lag of the grouser columns without ambiguous hubs, under the published names."""
    lags = [-1, 0, 2]
    strips = frames.unwrapped(pixels(spark, sf), ["run", "t", "hub"], "hub", lags, "grouser_noamb", 16)
    wide = series.named_features(frames.unwrap_features(strips, ["run"], "t"), ["run", "t"], ["unwrap_mean"], "grouser", lags)
    return wide.select("run", "t", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns[2:]])

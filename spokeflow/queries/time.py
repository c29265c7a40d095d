"""Time bins, joins in time order, running and trailing statistics, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.functions import arrays
from spokeflow.functions import scalars as s
from spokeflow.functions.windows import circular_running, gaussian, reach, running, trailing, trailing_slope
from spokeflow.operators import asof, binning, masks, series, turning
from spokeflow.plans import spread
from spokeflow.plans.spread import in_pieces, owned
from spokeflow.queries import EV, events, query, r6, rounded, table

_GRID = f"""g AS (SELECT user_id, min(t) AS start, greatest(ceil((max(t) - min(t)) / 3600) - 1, 0)::BIGINT AS bins FROM {EV} GROUP BY 1),
b0 AS (SELECT e.*, g.start, g.bins, floor((t - start) / 3600)::BIGINT AS i FROM {EV} e JOIN g USING (user_id)),
b1 AS (SELECT *, CASE WHEN t < start + i * 3600.0::DOUBLE THEN i - 1 WHEN t >= start + (i + 1) * 3600.0::DOUBLE THEN i + 1 ELSE i END AS j FROM b0),
b AS (SELECT *, CASE WHEN j = bins AND t <= start + bins * 3600.0::DOUBLE THEN bins - 1 ELSE j END AS bin FROM b1),
k AS (SELECT * FROM b WHERE bin >= 0 AND bin < bins)"""


def _binned(spark: SparkSession, sf: str, width: float = 3600.0) -> DataFrame:
    e = events(spark, sf)
    return binning.on_grid(e, binning.grid(e, "t", ["user_id"], width), "t", ["user_id"], width)


@query(f"WITH {_GRID} SELECT user_id, event_type, bin, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM k GROUP BY ALL")
def bin_mean(spark, sf):
    k = _binned(spark, sf)
    return k.groupBy("user_id", "event_type", "bin").agg(r6(F.avg("value")).alias("value"), F.count("*").alias("n"))


@query(f"""WITH {_GRID}, m AS (SELECT user_id, bin, event_type, avg(value) AS v FROM k GROUP BY ALL),
j AS (SELECT a.user_id, a.bin, a.v AS click, c.v AS view, p.v AS purchase FROM (SELECT * FROM m WHERE event_type = 'click') a
  JOIN (SELECT * FROM m WHERE event_type = 'view') c USING (user_id, bin) LEFT JOIN (SELECT * FROM m WHERE event_type = 'purchase') p USING (user_id, bin))
SELECT user_id, bin, round(click, 6) AS click, round("view", 6) AS "view", round(purchase, 6) AS purchase,
  round(avg(click) OVER (PARTITION BY user_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS click_mean FROM j""")
def aligned_bins(spark, sf):
    """Streams on one grid: two required, one optional, then a running mean."""
    k = _binned(spark, sf)
    one = lambda c: binning.bin_means(k.where(F.col("event_type") == c), ["user_id"], ["value"]).withColumnRenamed("value", c)
    j = binning.align([one("click"), one("view")], [one("purchase")], ["user_id", "bin"])
    j = j.withColumn("click_mean", running(F.col("click"), "mean", ["user_id"], ["bin"], 5, 5))
    return j.select("user_id", "bin", *[F.round(c, 6).alias(c) for c in ("click", "view", "purchase", "click_mean")])


@query(f"""WITH {_GRID} SELECT user_id, bin, round(((degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) % 360) + 360) % 360, 6) + 0.0 AS angle
FROM (SELECT *, (value * 7) % 360 AS a FROM k) GROUP BY 1, 2""")
def circular_bin_mean(spark, sf):
    k = _binned(spark, sf).withColumn("a", (F.col("value") * 7) % 360)
    return rounded(binning.bin_angles(k, ["user_id"], "a", "angle"), "angle")


@query(f"""WITH e AS (SELECT *, radians((value * 7) % 360) AS a FROM {EV})
SELECT user_id, event_id, round(((degrees(atan2(avg(sin(a)) OVER w, avg(cos(a)) OVER w)) % 360) + 360) % 360, 6) + 0.0 AS angle
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def smoothed_angle(spark, sf):
    e = events(spark, sf).withColumn("a", (F.col("value") * 7) % 360)
    return e.select("user_id", "event_id", r6(circular_running(F.col("a"), ["user_id"], ["t", "event_id"], 5, 5)).alias("angle"))


@query(f"""WITH x AS (SELECT user_id, bin, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS rock, avg(value) AS depth, min(CASE WHEN value > 60 AND value <= 80 THEN value END) AS f
  FROM (WITH {_GRID} SELECT * FROM k) GROUP BY 1, 2),
y AS (SELECT *, coalesce(lag(rock) OVER (PARTITION BY user_id ORDER BY bin), rock) + rock = 1 AND min(f) OVER (PARTITION BY user_id) IS NOT NULL AS half, min(f) OVER (PARTITION BY user_id) AS first FROM x)
SELECT user_id, bin, CASE WHEN half THEN 1 ELSE rock END AS rock, round(CASE WHEN half THEN first ELSE depth END, 6) AS rock_depth FROM y""")
def rock_bins(spark, sf):
    flag = F.when(F.col("value") > 80, 2).when(F.col("value") > 60, 1).otherwise(0)
    k = _binned(spark, sf).withColumns({"rock": flag, "rock_depth": F.col("value")})
    return binning.bin_rocks(k, ["user_id"]).withColumn("rock_depth", F.round("rock_depth", 6))


@query(f"""SELECT label, i AS at, round(avg(v), 6) + 0.0 AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL""")
def frame_means(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label"), F.lit(0).alias("bin"), F.col("embedding").cast("array<double>").alias("frame"))
    m = binning.bin_frames(e, ["label"], "frame")
    return m.select("label", F.posexplode("frame").alias("at", "v")).select("label", F.col("at").cast("bigint").alias("at"), r6("v").alias("mean"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS m0, round(avg(l_extendedprice), 6) AS m1, round(avg(l_discount), 6) AS m2, round(avg(l_tax), 6) AS m3,
round(avg(l_quantity * l_discount), 6) AS m4, round(avg(l_quantity * l_tax), 6) AS m5 FROM lineitem GROUP BY 1""")
def vector_mean(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"x4": F.col("l_quantity") * F.col("l_discount"), "x5": F.col("l_quantity") * F.col("l_tax")})
    six = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "x4", "x5"]
    return li.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 6).alias(f"m{i}") for i, c in enumerate(six)])


_W = "PARTITION BY user_id ORDER BY t, event_id"


@query(f"""SELECT event_id, round(avg(value) OVER a, 6) AS mean, round(median(value) OVER a, 6) AS median, round(stddev_pop(value) OVER a, 6) + 0.0 AS std,
round(avg(value) OVER b, 6) AS sink_mean FROM {EV}
WINDOW a AS ({_W} ROWS BETWEEN 10 PRECEDING AND 3 FOLLOWING), b AS ({_W} ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)""")
def running_statistics(spark, sf):
    e, run, order = events(spark, sf), ["user_id"], ["t", "event_id"]
    one = lambda k: running(F.col("value"), k, run, order, 10, 3)
    return e.select(
        "event_id", F.round(one("mean"), 6).alias("mean"), F.round(one("median"), 6).alias("median"), r6(one("std")).alias("std"),
        F.round(running(F.col("value"), "mean", run, order, 100), 6).alias("sink_mean"),
    )


_T = "PARTITION BY event_type ORDER BY t, event_id"


@query(f"""WITH e AS (SELECT *, row_number() OVER ({_T}) AS rn, value - lag(value) OVER ({_T}) AS d FROM {EV})
SELECT event_id, round(avg(value) OVER w, 6) AS sink_mean, round(stddev_pop(value) OVER w, 6) + 0.0 AS sink_std, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(value, rn) OVER w END, 6) + 0.0 AS sink_slope,
round(max(CASE WHEN user_id % 5 <> 0 THEN value - user_id END) OVER w, 6) + 0.0 AS max_diff, round(min(CASE WHEN user_id % 5 <> 0 THEN value - user_id END) OVER w, 6) + 0.0 AS min_diff,
round(stddev_pop(d) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) + 0.0 AS smness
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)""")
def trailing_features(spark, sf):
    e = in_pieces(events(spark, sf), ["event_type"], ["t", "event_id"], 201)
    run, order = ["event_type", "_piece"], ["_rn"]
    e = series.smoothness(e, "value", run, order)
    e = e.withColumn("user", F.col("user_id").cast("double"))
    e = series.npix_differences(e, run, order, "value", "user", F.col("user_id") % 5 == 0)
    x = F.col("value")
    e = e.withColumns({"sink_mean": trailing(x, "mean", run, order), "sink_std": trailing(x, "std", run, order), "sink_slope": trailing_slope(x, run, order)})
    return owned(e).select(
        "event_id", F.round("sink_mean", 6).alias("sink_mean"), r6("sink_std").alias("sink_std"), r6("sink_slope").alias("sink_slope"),
        r6("npix_max_diff").alias("max_diff"), r6("npix_min_diff").alias("min_diff"), r6("smness").alias("smness"),
    )


@query(f"""WITH c AS (SELECT * FROM {EV} WHERE event_type = 'click'), p AS (SELECT user_id, t AS pt, event_id AS pid, value AS pv FROM {EV} WHERE event_type = 'purchase'),
l AS (SELECT user_id, arg_max(pid, pt) AS lid, arg_max(pv, pt) AS lv FROM p GROUP BY 1)
SELECT c.event_id, coalesce(p.pid, l.lid) AS pid, coalesce(p.pv, l.lv) AS pv FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.pt LEFT JOIN l ON c.user_id = l.user_id""")
def asof_backward(spark, sf):
    """The sweep before each row; rows before the first take the last."""
    e = events(spark, sf)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("pt"), F.col("event_id").alias("pid"), F.col("value").alias("pv"))
    c = e.where("event_type = 'click'").select("user_id", "t", "event_id")
    return asof.backward(c, p, ["user_id"], "t", "pt", ["pid", "pv"], wrap=True).select("event_id", "pid", "pv")


@query(f"""WITH c AS (SELECT * FROM {EV} WHERE event_type = 'click'), p AS (SELECT user_id, t AS pt, event_id AS pid FROM {EV} WHERE event_type = 'purchase')
SELECT c.event_id, arg_min(pid, (abs(c.t - pt), pt)) AS pid FROM c LEFT JOIN p USING (user_id) GROUP BY 1""")
def asof_nearest(spark, sf):
    e = events(spark, sf)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("pt"), F.col("event_id").alias("pid"))
    c = e.where("event_type = 'click'").select("user_id", "t", "event_id")
    return asof.nearest(c, p, ["user_id"], "t", "pt", ["pid"]).select("event_id", "pid")


@query(f"""SELECT user_id, f.x AS target, arg_min(event_id, (abs(value - f.x), value, event_id)) AS event_id FROM {EV}, (VALUES (10.0::DOUBLE), (25.5::DOUBLE), (60.0::DOUBLE)) f(x) GROUP BY ALL""")
def nearest_frequency(spark, sf):
    return asof.nearest_value(events(spark, sf), ["user_id"], "value", [10.0, 25.5, 60.0], ["event_id"]).select("user_id", "target", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-06-01' THEN 2.5::DOUBLE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS offset_mean FROM orders""")
def calibration_by_date(spark, sf):
    import datetime as dt

    v = spark.createDataFrame([(dt.date(1996, 1, 1), 1.5), (dt.date(1998, 6, 1), 2.5)], "valid_from date, offset_mean double")
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return asof.valid_from(o, v, "day", "valid_from", ["offset_mean"], [0.5]).select("o_orderkey", "offset_mean")


@query("""WITH q AS (SELECT l_shipdate, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice > a - 0.2 * (b - a) AND l_extendedprice < b + 0.2 * (b - a) AS inlier FROM lineitem JOIN q USING (l_shipdate)""")
def iqr_inliers(spark, sf):
    li = masks.iqr_inlier(table(spark, sf, "lineitem"), "l_extendedprice", ["l_shipdate"], 0.2)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "inlier")


@query(f"""WITH a AS (SELECT *, stddev_pop(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS sd, count(*) OVER (PARTITION BY user_id) AS n FROM {EV}),
q AS (SELECT user_id, quantile_cont(sd, 0.25) AS s1, quantile_cont(sd, 0.75) AS s3, quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3 FROM a GROUP BY 1)
SELECT event_id, n > 10 AND sd > s1 - 5 * (s3 - s1) AND sd < s3 + 5 * (s3 - s1) AND value > v1 - 3 * (v3 - v1) AND value < v3 + 3 * (v3 - v1) AS clean FROM a JOIN q USING (user_id)""")
def clean_slip(spark, sf):
    return masks.clean_slip(events(spark, sf), "value", ["user_id"], ["t", "event_id"]).select("event_id", "clean")


@query(f"""WITH e AS (SELECT *, CASE WHEN value < 10 OR user_id % 10 = 0 THEN 0 ELSE value END AS c FROM {EV}), m AS (SELECT *, bool_or(c <> 0) OVER (PARTITION BY user_id) AS any_on FROM e),
k AS (SELECT *, row_number() OVER ({_W}) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM m WHERE c <> 0 OR NOT any_on)
SELECT event_id, rn AS t FROM k WHERE rn >= least(20, n - 1)""")
def moving_after_burn_in(spark, sf):
    e = events(spark, sf).drop("ts")
    e = e.withColumn("c", F.when((F.col("value") < 10) | (F.col("user_id") % 10 == 0), F.lit(float("nan"))).otherwise(F.col("value")))
    e = masks.moving(e.withColumnRenamed("t", "at"), "c", ["user_id"])
    return masks.burn_in(e, ["user_id"], ["at", "event_id"], 20).select("event_id", F.col("t").cast("bigint").alias("t"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE l_quantity / l_discount END AS x FROM lineitem)
WHERE NOT isnan(x) AND l_tax BETWEEN 0.02 AND 0.06""")
def finite_and_ranged(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("x", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") / F.col("l_discount")))
    return masks.in_range(masks.finite_rows(li, ["x", "l_quantity"], "l_tax"), "l_tax", 0.02, 0.06).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH x AS (SELECT user_id, list(value ORDER BY t, event_id) AS x, avg(value) AS m, stddev_pop(value) AS sd, var_pop(value) AS v, median(value) AS md, max(value) - min(value) AS rg, count(*) AS n,
  quantile_cont(value, 0.3) AS q3, quantile_cont(value, 0.0) AS qa, quantile_cont(value, 0.8) AS qb FROM {EV} GROUP BY 1),
o AS (SELECT user_id, sum(abs(d)) AS asc_, var_pop(CASE WHEN a BETWEEN qa AND qb AND b BETWEEN qa AND qb THEN abs(d) END) AS cva, var_pop(CASE WHEN a BETWEEN qa AND qb AND b BETWEEN qa AND qb THEN d END) AS cv
  FROM (SELECT e.user_id, value AS b, lag(value) OVER ({_W.replace('user_id', 'e.user_id')}) AS a, value - lag(value) OVER ({_W.replace('user_id', 'e.user_id')}) AS d, qa, qb FROM {EV} e JOIN x USING (user_id)) GROUP BY 1),
c AS (SELECT user_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS rep FROM (SELECT user_id, value, count(*) AS k FROM {EV} GROUP BY ALL) GROUP BY 1),
st AS (SELECT user_id, max(CASE WHEN up THEN len ELSE 0 END) AS above, max(CASE WHEN dn THEN len ELSE 0 END) AS below FROM
  (SELECT user_id, up, dn, g, count(*) AS len FROM (SELECT e.user_id, value > m AS up, value < m AS dn, row_number() OVER (PARTITION BY e.user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY e.user_id, value > m, value < m ORDER BY t, event_id) AS g FROM {EV} e JOIN x USING (user_id)) GROUP BY ALL) GROUP BY 1)
SELECT x.user_id, round(len(list_filter(x.x, lambda y: abs(y - m) > 1.5 * sd)) / n::DOUBLE, 6) AS ratio_beyond, round(q3, 6) AS quantile_3, round(rep / n::DOUBLE, 6) AS reoccurring, above::INT AS above, below::INT AS below,
round(asc_, 6) AS changes, abs(m - md) < 0.95 * rg AS symmetric, round(coalesce(cva, 0), 6) AS cva, round(coalesce(cv, 0), 6) AS cv, round(v, 6) AS variance,
round(list_sum(list_transform(x.x[1:(n // 10 + CASE WHEN n % 10 > 0 THEN 1 ELSE 0 END)], lambda y: y * y)) / list_sum(list_transform(x.x, lambda y: y * y)), 6) AS energy_0
FROM x JOIN o USING (user_id) JOIN c USING (user_id) JOIN st USING (user_id)""")
def series_statistics(spark, sf):
    e = events(spark, sf)
    x = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda v: v["value"]).alias("x"))
    a = F.col("x")
    return x.select(
        "user_id", F.round(arrays.ratio_beyond(a, 1.5), 6).alias("ratio_beyond"), F.round(arrays.quantile(a, 0.3), 6).alias("quantile_3"),
        F.round(arrays.reoccurring_share(a), 6).alias("reoccurring"), arrays.longest_strike(a, True).alias("above"), arrays.longest_strike(a, False).alias("below"),
        F.round(arrays.sum_of_changes(a), 6).alias("changes"), arrays.looks_symmetric(a).alias("symmetric"), F.round(arrays.change_variance(a), 6).alias("cva"),
        F.round(arrays.change_variance(a, absolute=False), 6).alias("cv"), F.round(arrays.variance(a), 6).alias("variance"), F.round(arrays.energy_ratio(a, 0), 6).alias("energy_0"),
    )


_RATIOS, _QUANTILES = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0), [i / 10 for i in range(1, 10)]
_plain = lambda name: name.replace(".", "_")


@query(f"""WITH x AS (SELECT user_id, list(value ORDER BY t, event_id) AS x, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n, sum(value * value) AS e,
{', '.join(f"quantile_cont(value, {q}) AS q{i}" for i, q in enumerate(_QUANTILES))} FROM {EV} GROUP BY 1)
SELECT user_id, {', '.join(f"round(len(list_filter(x, lambda y: abs(y - m) > {r} * sd)) / n::DOUBLE, 6) AS {_plain(f'ratio_beyond_{r}_sigma')}" for r in _RATIOS)},
{', '.join(f"round(q{i}, 6) AS {_plain(f'quantile_{q}')}" for i, q in enumerate(_QUANTILES))},
{', '.join(f"round(coalesce(list_sum(list_transform(x[({i} * (n // 10) + least({i}, n % 10) + 1):({i} * (n // 10) + least({i}, n % 10) + n // 10 + CASE WHEN {i} < n % 10 THEN 1 ELSE 0 END)], lambda y: y * y)), 0) / e, 6) + 0.0 AS energy_ratio_{i}" for i in range(10))} FROM x""")
def series_columns(spark, sf):
    """All ratios, quantiles and energies of the catalogue of series features."""
    x = events(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda v: v["value"]).alias("x"))
    every = series.series_columns(F.col("x"))
    return x.select("user_id", *[r6(c).alias(_plain(n)) for n, c in every.items() if n.startswith(("ratio_", "quantile_", "energy_"))])


@query()
def trailing_wavelet_features(spark, sf):
    """Peaks by ridges of a wavelet transform have no SQL form; the other features are compared in trailing_peaks_and_flats."""
    return series.trailing_series(events(spark, sf), "value", ["event_type"], ["t", "event_id"])


_HALF = "list_transform(range(1, (len({0}) + 1) // 2 + 1), lambda i: ({0}[2 * i - 1] + {0}[least(2 * i, len({0}))]) / 2)"
_SD = "CASE WHEN len({0}) > 1 THEN list_aggregate(list_transform(range(2, len({0}) + 1), lambda i: {0}[i] - {0}[i - 1]), 'stddev_pop') END"


@query(f"""WITH e AS (SELECT event_id, list(floor(value / 10)) OVER ({_T} ROWS BETWEEN 200 PRECEDING AND CURRENT ROW) AS x FROM {EV}),
m AS (SELECT *, len(x) AS n, list_transform(range(1, len(x) + 1), lambda i: list_avg(x[greatest(i - 2, 1):least(i + 2, len(x))])) AS m, {_HALF.format('x')} AS c1 FROM e),
h2 AS (SELECT *, {_HALF.format('c1')} AS c2 FROM m), h3 AS (SELECT *, {_HALF.format('c2')} AS c3 FROM h2), h4 AS (SELECT *, {_HALF.format('c3')} AS c4 FROM h3),
p AS (SELECT *, CASE WHEN n < 16 THEN x WHEN n < 32 THEN c1 WHEN n < 64 THEN c2 WHEN n < 128 THEN c3 ELSE c4 END AS c,
  list_transform(list_filter(range(2, n), lambda i: x[i] > x[i - 1] AND x[i] > x[i + 1]), lambda i: m[i]) AS top, list_transform(list_filter(range(2, n), lambda i: x[i] < x[i - 1] AND x[i] < x[i + 1]), lambda i: m[i]) AS low,
  CASE WHEN n > 1 THEN list_transform(range(1, (n + 1) // 2 + 1), lambda i: x[2 * i - 1] = x[least(2 * i, n)]) ELSE [x[1] = 0] END AS z, CASE WHEN n > 1 THEN 2 ELSE 1 END AS wide FROM h4),
r AS (SELECT *, list_filter(list_transform(range(2, len(c) + 1), lambda i: abs(c[i] - c[i - 1])), lambda d: d > 1e-9) AS d,
  list_filter(range(1, len(z) + 1), lambda i: z[i] AND (i = 1 OR NOT z[greatest(i - 1, 1)])) AS a, list_filter(range(1, len(z) + 1), lambda i: z[i] AND (i = len(z) OR NOT z[least(i + 1, len(z))])) AS b FROM p),
f AS (SELECT *, list_filter(list_transform(range(2, len(a)), lambda i: wide * (b[i] - a[i] + 1)), lambda k: k > 4) AS f FROM r)
SELECT event_id, round({_SD.format('low')}, 8) + 0.0 AS peak_max_std, round({_SD.format('top')}, 8) + 0.0 AS peak_min_std, round({_SD.format('x')}, 8) + 0.0 AS smness, round(coalesce(list_max(d), 0), 8) + 0.0 AS wt_jump_max,
round(list_avg(d), 8) AS wt_jump_mean, round(list_min(c), 8) + 0.0 AS wt_min, round(list_max(c), 8) + 0.0 AS wt_max, coalesce(list_max(f), 0)::DOUBLE AS len_max_flat, len(f)::DOUBLE AS n_flat FROM f""")
def trailing_peaks_and_flats(spark, sf):
    """Trailing features of counts: peaks, smoothness, jumps and flats."""
    e = events(spark, sf).withColumn("npix", F.floor(F.col("value") / 10).cast("double"))
    out = series.trailing_series(e, "npix", ["event_type"], ["t", "event_id"], cwt=False)
    names = [n for n in series.SERIES if n != "peak_max_std_cwt"]
    return out.select("event_id", *[(F.round(n, 8) + 0.0).alias(n) for n in names])


@query(f"""WITH e AS (SELECT event_id, event_type, value, row_number() OVER ({_T}) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {EV}), w AS (SELECT k, exp(-0.5 * (k / 3.0::DOUBLE) ** 2) AS w FROM range(-12, 13) r(k)),
j AS (SELECT e.event_id, e.event_type, n, w, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM e, w)
SELECT j.event_id, round(sum(w * f.value) / (SELECT sum(w) FROM w), 6) + 0.0 AS smooth FROM j JOIN e f ON f.event_type = j.event_type AND f.i = CASE WHEN j >= j.n THEN 2 * j.n - 1 - j ELSE j END GROUP BY 1""")
def gaussian_smoothing(spark, sf):
    e = in_pieces(events(spark, sf), ["event_type"], ["t", "event_id"], reach(3.0), reach(3.0))
    smooth = gaussian(F.col("value"), 3.0, ["event_type", "_piece"], ["_rn"], number=F.col("_rn"), count=F.col("_n"))
    return owned(e.withColumn("smooth", smooth)).select("event_id", r6("smooth").alias("smooth"))


@query(f"""WITH a AS (SELECT user_id, event_id, t, ceil(CASE WHEN value > 90 THEN 360 ELSE (value * 4) % 360 END)::BIGINT AS a, row_number() OVER ({_W}) AS i FROM {EV}),
p AS (SELECT *, max(CASE WHEN a = 360 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a)
SELECT user_id, round(count(CASE WHEN a = 360 AND i - p > 100 THEN 1 END) + (360.0 - arg_min(a, i) + arg_max(a, i)) / 360.0, 6) + 0.0 AS n_rot,
round(1 - least(200.0 / nullif((count(CASE WHEN a = 360 AND i - p > 100 THEN 1 END) + (360.0 - arg_min(a, i) + arg_max(a, i)) / 360.0) * 165.0, 0), 1.0), 6) + 0.0 AS mean_slip FROM p GROUP BY 1""")
def wheel_rotations(spark, sf):
    e = events(spark, sf).withColumn("a", F.when(F.col("value") > 90, 360.0).otherwise((F.col("value") * 4) % 360))
    return rounded(series.rotations(e, "a", ["user_id"], ["t", "event_id"]), "n_rot", "mean_slip")


def _turning_sql(rows: str, run: str) -> str:
    """Five rounds of best cuts; `rows` gives the run, i from 0, n rows and the sine s."""
    rounds, last = "", "p0"
    for k in range(1, 6):
        rounds += f""", b{k} AS (SELECT p.g, p.a, max({{'gain': (r.s - p.sa) ** 2 / (r.i - p.a) + (p.sb - r.s) ** 2 / (p.b - r.i), 'at': -r.i, 's': r.s}}) AS c
FROM p{k - 1} p JOIN r ON r.g IS NOT DISTINCT FROM p.g AND r.i > p.a AND r.i < p.b WHERE p.o GROUP BY 1, 2),
j{k} AS (SELECT p.*, c, p.o AND c IS NOT NULL AND c.gain - (p.sb - p.sa) ** 2 / (p.b - p.a) > 1e-12 AS cut FROM p{k - 1} p LEFT JOIN b{k} b ON b.g IS NOT DISTINCT FROM p.g AND b.a = p.a),
p{k} AS (SELECT g, n, a, CASE WHEN cut THEN -c.at ELSE b END AS b, sa, CASE WHEN cut THEN c.s ELSE sb END AS sb, coalesce(cut, false) AS o FROM j{k}
UNION ALL SELECT g, n, -c.at, b, c.s, sb, true FROM j{k} WHERE cut)"""
        last = f"p{k}"
    return f"""WITH r AS ({rows}), p0 AS (SELECT g, max(n) AS n, 0::BIGINT AS a, max(n) - 1 AS b, max(CASE WHEN i = 0 THEN s END) AS sa, max(CASE WHEN i = n - 1 THEN s END) AS sb, true AS o FROM r GROUP BY g){rounds},
q AS (SELECT *, b > a AND abs((sb - sa) / (b - a)) < 1e-4 AS calm FROM {last}), e AS (SELECT *, coalesce(lag(calm) OVER w IS DISTINCT FROM calm, true) AS fresh FROM q WINDOW w AS (PARTITION BY g ORDER BY a, b)),
z AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM e), y AS (SELECT g, n, span, bool_and(calm) AS calm, min(a) AS a, max(b) AS b FROM z GROUP BY g, n, span),
x AS (SELECT *, lag(calm) OVER w AS calm_before, lag(b - a) OVER w AS before FROM y WINDOW w AS (PARTITION BY g ORDER BY span))
SELECT g AS {run}, coalesce(min(CASE WHEN calm_before AND before >= 15 AND b - a >= 15 THEN a - 1 END), 0)::INT AS start,
coalesce(min(CASE WHEN NOT calm_before AND before >= 15 AND b - a >= 15 THEN a - 1 END), max(n) - 1)::INT AS stop FROM x GROUP BY g"""


@query(_turning_sql(f"SELECT user_id AS g, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, sin(radians(value)) AS s FROM {EV}", "user_id"))
def wheel_turning(spark, sf):
    return turning.turning(events(spark, sf), "value", "user_id", ["t", "event_id"])


@query(_turning_sql(f"""SELECT g, i, n, sin(radians(CASE WHEN i < n // 5 THEN 0.0 WHEN i < n - n // 4 THEN ((i - n // 5) * 4.0) % 360 ELSE ((n - n // 4 - n // 5) * 4.0) % 360 END)) AS s FROM
(SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {EV})""", "event_type"))
def turning_of_long_runs(spark, sf):
    """Each event type is a run: its wheel stands for a fifth, turns, and stands for the last quarter."""
    rows = spread.numbered(events(spark, sf), ["event_type"], ["t", "event_id"])
    i, n = F.col("_rn"), F.col("_n")
    low, high = F.floor(n / 5), n - F.floor(n / 4)
    angle = F.when(i < low, 0.0).when(i < high, ((i - low) * 4.0) % 360).otherwise(((high - low) * 4.0) % 360)
    rows = rows.select("event_type", "t", "event_id", angle.alias("angle"))
    return turning.turning(rows, "angle", "event_type", ["t", "event_id"])


@query(f"""SELECT event_id, round(sum(value * d) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS position FROM
(SELECT *, coalesce(t - lag(t) OVER ({_W}), 0) AS d FROM {EV})""")
def flow_position(spark, sf):
    from spokeflow.streaming.live import integrated

    return integrated(events(spark, sf), "value", "t", ["user_id"]).select("event_id", (F.round("position", 3) + 0.0).alias("position"))


@query(f"""SELECT event_id, ((user_id * 37) % 205 + 205) % 205 % 100 AS wrapped, (16 - ceil((value * 3.6) * 95 / 360)::BIGINT % 96 + 96) % 96 AS contact_column,
((user_id - 40 + 48) % 96 + 96) % 96 - 48 AS lag, round(sqrt(value * value + user_id * user_id), 6) AS amplitude, round(atan2(user_id, value), 6) + 0.0 AS phase,
round(CASE WHEN user_id % 9 > 0 THEN 254.5 * (cos((user_id % 9) * (1598.0::DOUBLE / 96) / 254.5) - 1) ELSE 0 END, 6) + 0.0 AS sink,
round(2 * value - user_id, 6) + 0.0 AS moment, CASE WHEN value * 3.6 > 250 AND value * 3.6 < 290 THEN NULL ELSE value END AS seen FROM {EV}""")
def scalar_expressions(spark, sf):
    e = events(spark, sf)
    v, u = F.col("value"), F.col("user_id")
    return e.select(
        "event_id", s.wrap(s.wrap(u * 37, 205), 100).alias("wrapped"), s.contact_column(v * 3.6).cast("bigint").alias("contact_column"), s.signed_lag(u, F.lit(40)).alias("lag"),
        F.round(s.amplitude(v, u), 6).alias("amplitude"), r6(s.phase(v, u)).alias("phase"), r6(s.sinkage(u % 9)).alias("sink"),
        r6(s.transform([[2.0, -1.0]], [v, u])[0]).alias("moment"), s.blind_spot(v, v * 3.6).alias("seen"),
    )


@query(f"""SELECT event_id, round(sqrt(v * v + u * u + 1), 6) AS r, round(acos(1 / sqrt(v * v + u * u + 1)), 6) AS theta, round(atan2(u, v), 6) + 0.0 AS phi, round(v * 641.42::DOUBLE, 6) AS mm, v / 256 AS pressure
FROM (SELECT event_id, value AS v, user_id::DOUBLE AS u FROM {EV})""")
def sensor_geometry(spark, sf):
    e = events(spark, sf)
    v, u = F.col("value"), F.col("user_id").cast("double")
    g = s.spherical(v, u, F.lit(1.0))
    return e.select(
        "event_id", F.round(g["r"], 6).alias("r"), F.round(g["theta"], 6).alias("theta"), r6(g["phi"]).alias("phi"),
        F.round(s.scaled(v, 641.42), 6).alias("mm"), s.scaled(v, 1 / 256).alias("pressure"),
    )


@query(f"""WITH a AS (SELECT event_id, value / 100 - 0.4993 AS x, user_id / 50.0::DOUBLE - 0.0772 AS y, value / 50 - 1 + 1.4496 AS z FROM {EV})
SELECT event_id, round(sqrt(x * x + y * y + z * z), 6) AS r, round(degrees(acos(z / sqrt(x * x + y * y + z * z))), 5) AS theta, round(sign(y) * degrees(acos(x / sqrt(x * x + y * y))), 5) + 0.0 AS phi,
round(((degrees(atan(z / (x + 1e-11))) + CASE WHEN x >= 0 THEN 0 ELSE 180 END) % 360 + 360) % 360, 5) + 0.0 AS rot FROM a""")
def imu_angles(spark, sf):
    e = events(spark, sf)
    g = s.imu_angles(F.col("value") / 100, F.col("user_id") / F.lit(50.0), F.col("value") / 50 - 1)
    return e.select("event_id", F.round(g["r"], 6).alias("r"), F.round(g["theta"], 5).alias("theta"), (F.round(g["phi"], 5) + 0.0).alias("phi"), (F.round(g["rot"], 5) + 0.0).alias("rot"))


_M = [[(((3 * i + 5 * j) % 7) - 3.1) / 7.3 for j in range(6)] for i in range(6)]
_SIX = ["l_quantity", "l_extendedprice / 1000", "l_discount", "l_tax", "l_quantity * l_discount", "l_quantity * l_tax"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join("round(" + " + ".join(f"({m}::DOUBLE) * ({v})" for m, v in zip(row, _SIX)) + f", 6) + 0.0 AS w{i}" for i, row in enumerate(_M)) + " FROM lineitem")
def force_transform(spark, sf):
    """Six readings by a constant 6 x 6 matrix."""
    li = table(spark, sf, "lineitem")
    out = s.transform(_M, [F.expr(v) for v in _SIX])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(f"w{i}") for i, c in enumerate(out)])


@query(f"""WITH s AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, list(value ORDER BY t, event_id) AS re, list(event_id::DOUBLE ORDER BY t, event_id) AS im, list(value * 10 ORDER BY t, event_id) AS freq FROM {EV} GROUP BY 1, 2),
p AS (SELECT *, list_position(list_transform(freq, lambda f: abs(f - 554.863)), list_min(list_transform(freq, lambda f: abs(f - 554.863)))) AS i FROM s),
a AS (SELECT user_id, day, sqrt(re[i] * re[i] + im[i] * im[i]) AS a, atan2(im[i], re[i]) AS f FROM p)
SELECT user_id, day, round(a, 6) AS amplitude, round(avg(a) OVER w, 6) AS amplitude_mean, round(avg(f) OVER w, 6) + 0.0 AS phase_mean FROM a WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def impedance_features(spark, sf):
    from spokeflow.operators import impedance

    e = events(spark, sf)
    rows = F.array_sort(F.collect_list(F.struct("t", "event_id", "value")))
    sweeps = e.groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(rows.alias("r")).select(
        "user_id", "day", F.transform("r", lambda x: x["value"]).alias("re"), F.transform("r", lambda x: x["event_id"].cast("double")).alias("im"),
        F.transform("r", lambda x: x["value"] * 10).alias("freq"),
    )
    out = impedance.sweep_features(sweeps, [554.863], ["user_id"], ["day"], 5)
    return out.select("user_id", "day", F.round("amplitude_0", 6).alias("amplitude"), F.round("amplitude_0_mean", 6).alias("amplitude_mean"), r6("phase_0_mean").alias("phase_mean"))

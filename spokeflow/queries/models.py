"""Ensembles, predictions and what judges them."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from spokeflow.operators import assemble, evaluate, forest, levels, masks, ml
from spokeflow.plans.lineage import shared_folder, written
from spokeflow.queries import events, query, r6, rounded, table
from spokeflow.sources import writers


def _wide(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("run"), F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])


_F = [f"f{i}" for i in range(64)]


@query("""WITH RECURSIVE g AS (SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS i FROM lineitem GROUP BY 1),
s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS l_suppkey, 0::BIGINT AS fold, list_transform(range(10), lambda x: 0::BIGINT) AS held
  UNION ALL SELECT g.i, g.l_suppkey, list_position(held, list_min(held)) - 1, list_transform(range(1, 11), lambda k: held[k] + CASE WHEN k = list_position(held, list_min(held)) THEN g.n ELSE 0 END) FROM s JOIN g ON g.i = s.i + 1)
SELECT l_suppkey, fold::INT AS fold FROM s WHERE i > 0""")
def group_folds(spark, sf):
    """Groups, the largest first, each in the fold of the fewest rows so far."""
    return assemble.group_folds(table(spark, sf, "lineitem"), "l_suppkey", 10)


@query()
def slip_regression(spark, sf):
    """Out-of-fold predictions of boosted regression trees, by run."""
    df = _wide(spark, sf)
    out = ml.out_of_fold(df, ml.regressor(_F, trees=5, leaf=20), "run", folds=3)
    return evaluate.errors(out, "label", "prediction", ["fold"]).select("fold", r6("rmse").alias("rmse"))


@query()
def composition_classes(spark, sf):
    """Boosted trees, one class against the rest."""
    df = _wide(spark, sf)
    model = ml.boosted_classifier(_F, trees=3, leaf=20).fit(df)
    return evaluate.confusion(model.transform(df), "label", "prediction")


@query()
def hydration_levels(spark, sf):
    """Out-of-fold levels over stratified folds, without rows at the angle that is left out."""
    df = ml.without_angle(_wide(spark, sf).withColumn("rot", (F.col("id") % 36 * 10).cast("double")), "rot")
    out = ml.hydration(ml.out_of_stratum(df, ml.forest_classifier(_F), "label", 3, [ml.SEED]), "rot")
    return out.select("id", r6("p_dry").alias("p_dry"), r6("p_max").alias("p_max"), "level")


@query()
def composition_names(spark, sf):
    df = _wide(spark, sf)
    model = ml.forest_classifier(_F, trees=5).fit(df)
    names = [f"class{i}" for i in range(64)]
    return ml.with_class(model.transform(df), names).select("id", r6("confidence").alias("confidence"), "class")


@query()
def cart_forest(spark, sf):
    """Forest by majority shares: one task a tree, then votes in Arrow batches."""
    df = _wide(spark, sf)
    classes = 1 + int(df.agg(F.max("label")).first()[0])
    nodes = forest.fit_forest(df, _F, "label", classes, trees=8, max_depth=6)
    return forest.apply_forest(df, forest.load_trees(nodes), _F, classes).select("id", "prediction")


@query()
def forest_importances(spark, sf):
    df = _wide(spark, sf)
    ranked = ml.importances(ml.forest_classifier(_F, trees=5).fit(df), _F)
    return evaluate.top(spark.createDataFrame(ranked, "feature string, importance double"), "importance", 5, ["feature"])


@query("SELECT event_id, 'nan'::DOUBLE AS surface FROM events")
def surface_stub(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", ml.surface(e).alias("surface"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return rounded(evaluate.confusion(table(spark, sf, "labels"), "quality", "toxic"), "share")


_RES = "(SELECT l_returnflag, l_discount * 10 AS y, l_tax * 10 AS yhat FROM lineitem)"


@query(f"SELECT l_returnflag, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(yhat - y), 6) + 0.0 AS bias, round(stddev_pop(yhat - y), 6) AS spread, round(avg(CASE WHEN yhat - y = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM {_RES} GROUP BY 1")
def prediction_errors(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("yhat"))
    return rounded(evaluate.errors(li, "y", "yhat", ["l_returnflag"]), "rmse", "bias", "spread", "accuracy")


@query(f"SELECT floor(y / 0.05)::INT AS bin, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(yhat - y), 6) + 0.0 AS bias FROM {_RES} WHERE y >= 0 AND y < 1.1 GROUP BY 1")
def residuals_by_bin(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("yhat"))
    return rounded(evaluate.binned_residuals(li, "y", "yhat").select("bin", "rmse", "bias"), "rmse", "bias")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-s, event_type)) AS best, round(max(s), 6) AS score FROM m GROUP BY 1""")
def best_class(spark, sf):
    return rounded(evaluate.best_class(events(spark, sf), ["user_id"], "event_type", "value"), "score")


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n FROM events GROUP BY 1")
def share_above(spark, sf):
    return rounded(evaluate.share_of(events(spark, sf), F.col("value") > 50, ["event_type"]), "share")


@query("SELECT p_brand, p_type, round(median(p_retailprice), 6) AS median FROM part GROUP BY ALL")
def median_summary(spark, sf):
    return rounded(evaluate.medians(table(spark, sf, "part"), "p_retailprice", ["p_brand", "p_type"]), "median")


@query("""WITH b AS (SELECT least(floor((l_quantity - 0) / 0.5), 99)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER () / 0.5, 9) AS density FROM b""")
def quantity_histogram(spark, sf):
    out = evaluate.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 50.0)
    return out.withColumn("density", F.round("density", 9))


@query("""SELECT x / 10.0::DOUBLE AS x, round(avg(exp(-0.5 * ((x / 10.0::DOUBLE - value) / 0.5) ** 2)) / (0.5 * sqrt(2 * pi())), 9) + 0.0 AS density FROM events, range(0, 1000) r(x) GROUP BY 1""")
def kernel_density(spark, sf):
    out = evaluate.kernel_density(events(spark, sf), "value", [i / 10 for i in range(1000)])
    return out.withColumn("density", F.round("density", 9))


@query()
def feature_elimination(spark, sf):
    df = _wide(spark, sf)
    left = ml.eliminated(df, lambda f: ml.forest_classifier(f, trees=3, depth=4), _F, 16, 16)
    return spark.createDataFrame([(f,) for f in left], "feature string")


@query("""SELECT vec_id AS id, ((row_number() OVER (PARTITION BY label ORDER BY md5('5432:' || vec_id), vec_id) - 1) % 3)::INT AS fold FROM embeddings""")
def stratified_folds(spark, sf):
    return ml.stratified_folds(_wide(spark, sf).select("id", "label"), "label").select("id", "fold")


@query("SELECT vec_id AS id, 1.0::DOUBLE AS total FROM embeddings")
def class_probabilities(spark, sf):
    df = _wide(spark, sf)
    model = ml.forest_classifier(_F, trees=5).fit(df)
    p = vector_to_array("probability")
    return model.transform(df).select("id", r6(F.aggregate(p, F.lit(0.0), lambda a, b: a + b)).alias("total"))


def _probable(df):
    """Four class probabilities and an angle from a row's numbers."""
    parts = [F.abs(F.col(f"f{i}")) + 0.01 for i in range(4)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return df.select("id", (F.col("id") % 36 * 10).cast("double").alias("rot"), array_to_vector(F.array(*[p / total for p in parts])).alias("probability"))


@query("""WITH v AS (SELECT vec_id AS id, (vec_id % 36 * 10)::DOUBLE AS rot, list_transform(embedding[1:4], lambda x: abs(x::DOUBLE) + 0.01) AS a FROM embeddings), p AS (SELECT id, rot, list_transform(a, lambda x: x / list_sum(a)) AS p FROM v)
SELECT id, round(list_max(p), 6) AS confidence, 'class' || (list_position(p, list_max(p)) - 1) AS class, round(p[2], 6) AS rock, CASE WHEN rot > 250 AND rot < 290 THEN NULL ELSE round(p[1], 6) END AS p_dry,
CASE WHEN rot > 250 AND rot < 290 THEN NULL ELSE round(list_max(p), 6) END AS p_max, CASE WHEN rot > 250 AND rot < 290 THEN NULL ELSE (list_position(p, list_max(p)) - 1)::DOUBLE END AS level FROM p""")
def prediction_outputs(spark, sf):
    """What is read off class probabilities: name, rock, hydration."""
    out = ml.hydration(ml.with_rock(ml.with_class(_probable(_wide(spark, sf)), [f"class{i}" for i in range(4)])), "rot")
    return out.select("id", r6("confidence").alias("confidence"), "class", r6("rock").alias("rock"), r6("p_dry").alias("p_dry"), r6("p_max").alias("p_max"), "level")


@query("SELECT vec_id AS id, vec_id % 5 = 0 AS missing FROM embeddings")
def predictions_of_missing_features(spark, sf):
    """Every row has a prediction, NaN where a feature is missing."""
    df = _wide(spark, sf)
    model = ml.forest_classifier(_F[:8], trees=3, depth=4).fit(df)
    gaps = df.withColumn("f3", F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("f3")))
    return ml.predicted(model, gaps, _F[:8], ["id"]).select("id", F.isnan("prediction").alias("missing"))


@query("SELECT vec_id AS id, true AS same FROM embeddings")
def model_round_trip(spark, sf):
    """A fitted model saved, loaded and applied: equal predictions."""
    df = _wide(spark, sf)
    model = ml.forest_classifier(_F[:8], trees=3, depth=4).fit(df)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    ml.save_model(model, path)
    first, again = (ml.predicted(m, df, _F[:8], ["id"]) for m in (model, ml.load_model(path)))
    both = first.join(again.withColumnsRenamed({"prediction": "q", "probability": "r"}), "id")
    equal = (F.col("prediction") == F.col("q")) & (vector_to_array("probability") == vector_to_array("r"))
    return both.select("id", equal.alias("same"))


@query("SELECT vec_id AS id, true AS same FROM embeddings")
def forest_round_trip(spark, sf):
    """A forest's node table written and read: equal votes."""
    df = _wide(spark, sf)
    classes = 1 + int(df.agg(F.max("label")).first()[0])
    nodes = written(forest.fit_forest(df, _F, "label", classes, trees=4, max_depth=5, max_features="log2"))
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    writers.write_forest(nodes, path)
    out = forest.apply_forest(df, forest.load_trees(nodes), _F, classes, "p")
    out = forest.apply_forest(out, forest.read_forest(spark, path), _F, classes, "q")
    return out.select("id", (F.col("p") == F.col("q")).alias("same"))


_CART_ROOT = """WITH v AS (SELECT vec_id, ((vec_id * 37) % 101)::DOUBLE AS y, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS x FROM embeddings),
o AS (SELECT f, x, row_number() OVER w AS i, sum(y) OVER (PARTITION BY f ORDER BY x, vec_id ROWS UNBOUNDED PRECEDING) AS s, lead(x) OVER w AS z, count(*) OVER (PARTITION BY f) AS n, sum(y) OVER (PARTITION BY f) AS t FROM v WINDOW w AS (PARTITION BY f ORDER BY x, vec_id)),
g AS (SELECT f, (x + z) / 2 AS cut, s / i AS below, (t - s) / (n - i) AS above, s * s / i + (t - s) * (t - s) / (n - i) - t * t / n AS gain FROM o WHERE z - x >= 1e-6)
SELECT arg_max(f, gain)::INT AS feature, round(arg_max(cut, gain), 6) + 0.0 AS threshold, round(arg_max(below, gain), 6) AS below, round(arg_max(above, gain), 6) AS above FROM g"""


def _root(spark, sf, most_bins: int):
    """The root of a regression tree over all rows and features, and the means of its sides."""
    df = _wide(spark, sf).withColumn("y", (F.col("id") * 37 % 101).cast("double"))
    (tree,) = levels.forest_levels(df, _F, "y", 0, trees=1, bootstrap=False, max_depth=1, most_bins=most_bins, exact=True)
    sides = [float(tree.value[n]) for n in (tree.left[0], tree.right[0])]
    rows = [(int(tree.feature[0]), float(tree.threshold[0]), *sides)]
    return rounded(spark.createDataFrame(rows, "feature int, threshold double, below double, above double"), "threshold", "below", "above")


@query(_CART_ROOT)
def cart_root(spark, sf):
    """The split of largest gain over all rows and features, and the means of its sides, from sorted values."""
    return _root(spark, sf, 0)


@query(_CART_ROOT)
def cart_root_by_levels(spark, sf):
    """The same split from sums of all rows by node, feature and value; only features of more values than bins are sorted."""
    return _root(spark, sf, 1 << 13)


@query()
def composition_boosted(spark, sf):
    """Multinomial boosting over all rows and dimensions."""
    df = _wide(spark, sf)
    classes = 1 + int(df.agg(F.max("label")).first()[0])
    model = levels.boosted(df, _F, "label", classes, rounds=5, max_depth=3, min_leaf=5, subsample=0.5, max_features=21, most_bins=128)
    return levels.with_classes(df, model, _F).select("id", "prediction", r6(F.array_max("probability")).alias("confidence"))


_STUMPS = [(0, 0.0, 0, 0.9, 2, 0.6), (1, 0.01, 1, 0.7, 0, 0.55), (2, -0.02, 2, 0.5, 1, 0.8)]  # feature, threshold, class and share below and above


@query("WITH v AS (SELECT vec_id AS id, " + ", ".join(
    " + ".join(f"CASE WHEN embedding[{f + 1}]::DOUBLE < {t} THEN {sa if a == c else 0.0}::DOUBLE ELSE {sb if b == c else 0.0}::DOUBLE END" for f, t, a, sa, b, sb in _STUMPS) + f" AS v{c}" for c in range(3)
) + " FROM embeddings) SELECT id, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0.0::DOUBLE WHEN v1 >= v2 THEN 1.0 ELSE 2.0 END AS prediction FROM v")
def forest_votes(spark, sf):
    """Leaf shares summed by class over a forest; the largest sum, the first class on ties."""
    rows = []
    for k, (f, t, a, sa, b, sb) in enumerate(_STUMPS):
        rows += [(k, 0, f, t, 1, 2, 0.0, 0.0), (k, 1, -1, 0.0, -1, -1, float(a), sa), (k, 2, -1, 0.0, -1, -1, float(b), sb)]
    trees = forest.load_trees(spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double, share double"))
    return forest.apply_forest(_wide(spark, sf), trees, _F, 3).select("id", "prediction")


def _numbered(df, keys, name: str):
    """Adds numbers without gaps, from 0, in the order of hash buckets and of the keys in each; and how many there are."""
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(64)))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    out = rows.withColumn(name, own).join(F.broadcast(before), "_b").withColumn(name, F.col(name) + F.col("_before"))
    return out.drop("_b", "_n", "_before"), df.count()


def _lifecycle(spark, sf):
    """Events as the streams of a run, embeddings as its frames, through the whole chain of steps.

    Frames are dealt in turn to the moving bins of all runs: each bin has a frame and each frame a bin. Of more
    frames than bins, those of one bin are averaged."""
    from spokeflow.plans import lifecycle

    channel = F.create_map(*[F.lit(x) for x in ("click", "rho", "view", "slip", "purchase", "current", "error", "sink")])
    e = events(spark, sf)
    samples = e.select(F.col("user_id").alias("run_id"), channel[F.col("event_type")].alias("channel"), F.col("t").alias("ts"), "value").where("channel is not null")
    binned = written(lifecycle.unify(samples, width=6 * 3600.0))
    moving = masks.burn_in(masks.moving(binned, "current", ["run_id"], "rho", "bin"), ["run_id"], ["bin"], 0)
    bins, n_bins = _numbered(moving.select("run_id", "bin"), ["run_id", "bin"], "i")
    frame, n_frames = _numbered(table(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"], "j")
    turn = F.lit(max(1, min(n_bins, n_frames)))
    cells = frame.withColumn("k", F.col("j") % turn).select("k", F.posexplode("embedding").alias("i", "p"))
    dealt = bins.select("run_id", "bin", (F.col("i") % turn).alias("k")).join(cells, "k")
    pixels = dealt.groupBy("run_id", "bin", F.expr("i div 16").cast("int").alias("row"), ((F.col("i") % 16) * 6).alias("col")).agg((F.avg(F.col("p").cast("double")) * 100).alias("p"))
    return lifecycle.featurise(binned, pixels, low=0)


@query()
def lifecycle_features(spark, sf):
    """Streams on one grid, contact, sinkage and trailing features."""
    out = _lifecycle(spark, sf)
    return out.select("run_id", "t", "imu_bin", "npix_all", r6("area_ratio").alias("area_ratio"), r6("wheel_sink").alias("wheel_sink"), r6("sink_mean").alias("sink_mean"), r6("sink_std").alias("sink_std"))


@query()
def lifecycle_predictions(spark, sf):
    """A slip model fitted on the features and applied with its features picked by name."""
    from spokeflow.plans import lifecycle

    names = ["npix_all", "area_ratio", "sink_mean", "sink_std", "sink_diff_angle_mean", "sink_theta_m"]
    features = _lifecycle(spark, sf).select("run_id", "t", "slip", *[F.col(n).cast("double").alias(n) for n in names])
    rows = written(lifecycle.training_table([features], names, "slip", ["run_id", "t"]))
    model = ml.regressor(names, "slip", leaf=5).fit(rows)
    return ml.predicted(model, rows, names, ["run_id", "t"]).select("run_id", "t", r6("prediction").alias("prediction"))

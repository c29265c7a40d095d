import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow import catalog
from spokeflow.operators import forest, levels


def data(spark, n=300, seed=0, values=40):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)) * values / 4) / (values / 4)
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.01 * r.normal(size=n) > 0).astype(int) + (x[:, 3] > 1)
    rows = [(i, *v.tolist(), float(c), float(c + v[0])) for i, (v, c) in enumerate(zip(x, y))]
    return x, y.astype(float), spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, t double").repartition(5)


F4 = ["a", "b", "c", "d"]


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_equals_one_that_is_grown_from_sorted_rows(spark, classes, monkeypatch):
    x, y, df = data(spark)
    target = y if classes else y + x[:, 0]
    plain = forest.grow(x, target, classes, max_depth=5, min_leaf=3, max_features="none", bootstrap=False)
    for cells in (levels.CELLS, 4 * 60 * 3):  # few cells: a level takes several passes
        monkeypatch.setattr(levels, "CELLS", cells)
        (mine,) = levels.forest_levels(df, F4, "label" if classes else "t", classes, trees=1, bootstrap=False, max_depth=5, min_leaf=3)
        a, b = plain.leaves(x), mine.leaves(x)
        assert np.array_equal(plain.value[a], mine.value[b]) if classes else np.allclose(plain.value[a], mine.value[b])
        assert np.allclose(plain.share[a], mine.share[b]) and len(plain.feature) == len(mine.feature)
        assert np.allclose(np.sort(plain.threshold[plain.feature >= 0]), np.sort(mine.threshold[mine.feature >= 0]))


def test_quantile_bins_split_about_as_well(spark):
    x, y, df = data(spark, 800, 1, 4000)
    trees = levels.forest_levels(df, F4, "label", 3, trees=5, max_depth=6, most_bins=32, max_features="sqrt")
    assert len(trees) == 5 and (forest.predict(trees, x, 3) == y).mean() > 0.85
    assert len({len(t.feature) for t in trees}) > 1  # other rows and other features


def test_two_rounds_of_boosting_equal_plain_ones(spark):
    x, y, df = data(spark, 250, 2)
    model = levels.boosted(df, F4, "label", 3, rounds=2, rate=0.3, max_depth=3, min_leaf=4)
    share = np.bincount(y.astype(int), minlength=3) / len(y)
    score = np.tile(np.log(share), (len(y), 1))
    for _ in range(2):
        p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        g = np.eye(3)[y.astype(int)] - p
        for k in range(3):
            tree = forest.grow(x, g[:, k], 0, max_depth=3, min_leaf=4, max_features="none", bootstrap=False)
            at = tree.leaves(x)
            for leaf in set(at.tolist()):
                r = g[at == leaf, k]
                score[at == leaf, k] += 0.3 * (2 / 3 * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum())
    assert np.allclose(model.scores(x), score, atol=1e-9)
    got = {r.id: (r.prediction, r.probability) for r in levels.with_classes(df, model, F4).select("id", "prediction", "probability").collect()}
    want = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    assert all(np.allclose(got[i][1], want[i]) and got[i][0] == want[i].argmax() for i in range(len(y)))


def test_half_of_the_rows_a_round(spark):
    x, y, df = data(spark, 400, 3)
    model = levels.boosted(df, F4, "label", 3, rounds=6, rate=0.5, max_depth=3, subsample=0.5, max_features=2)
    assert (model.scores(x).argmax(1) == y).mean() > 0.85


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("most_bins", [0, 64])
def test_exact_trees_of_features_with_more_values_than_bins(spark, classes, most_bins):
    x, y, df = data(spark, 300, 4, 4000)
    x[:, 3] = np.round(x[:, 3])
    df = df.withColumn("d", F.expr("rint(d)"))  # one feature of few values
    target = y if classes else y + x[:, 0]
    df = df.withColumn("t", F.col("label") + F.col("a"))
    plain = forest.grow(x, target, classes, max_depth=3, min_leaf=3, max_features="none", bootstrap=False)
    (mine,) = levels.forest_levels(df, F4, "label" if classes else "t", classes, trees=1, bootstrap=False, max_depth=3, min_leaf=3, most_bins=most_bins, exact=True)
    a, b = plain.leaves(x), mine.leaves(x)
    assert len(plain.feature) == len(mine.feature) and np.allclose(plain.value[a], mine.value[b]) and np.allclose(plain.share[a], mine.share[b])
    assert np.allclose(np.sort(plain.threshold[plain.feature >= 0]), np.sort(mine.threshold[mine.feature >= 0]))


@pytest.mark.parametrize("name", ["cart_root", "cart_root_by_levels"])
def test_the_root_of_more_rows_than_a_sample_holds(spark, name, tmp_path):
    r = F.xxhash64("vec_id", "i") % 1_000_003 / 1_000_003.0
    cells = spark.range(51_000).select(F.col("id").alias("vec_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    rows = cells.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", r.alias("v")))), lambda c: c["v"].cast("float")).alias("embedding"))
    rows.withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    (got,) = catalog.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert np.allclose(tuple(got), con.execute(catalog.oracle_sql()[name]).fetchone(), atol=2e-6)

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.operators import boxes, dbscan, knn


def skewed(n, seed=3, dims=3):
    """A dense cube that holds most points, a line, and far points."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(0, 0.05, (n * 7 // 10, dims)), np.outer(r.uniform(0, 9, n * 2 // 10), np.ones(dims)), r.uniform(-9, 9, (n - n * 7 // 10 - n * 2 // 10, dims))])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(5)


def test_boxes_hold_the_surroundings_of_their_points(spark):
    x, reach = skewed(900), 0.02
    rows = boxes.boxed(frame(spark, x).withColumnRenamed("features", "x"), reach, 40).collect()
    home = {r.id: r.box for r in rows if r.own}
    held = {(r.box, r.id) for r in rows}
    assert len(home) == len(x) == sum(r.own for r in rows) and len(held) == len(rows)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= reach
    assert all((home[i], j) in held for i, j in zip(*(a.tolist() for a in np.nonzero(near))))
    sizes = np.bincount(np.unique(list(home.values()), return_inverse=True)[1])
    assert sizes.max() <= 80 and len(sizes) > 15  # the dense cube is cut too
    assert len(rows) < 3 * len(x)  # boxes of the cube are a few reaches wide


def test_dense_points_are_split_by_space(spark):
    """Pairs compared and rows sent on skewed points, against those of blocks that all meet."""
    df = frame(spark, skewed(4000))
    work = dbscan.work_of(df, 0.01, block=64).first()
    assert work.points == 4000
    everything = 4000 * 3999 // 2
    assert work.pairs < 0.06 * everything and work.rows < 4 * work.points, work
    same = frame(spark, np.zeros((600, 3)))  # nothing parts equal points: their blocks all meet
    assert dbscan.work_of(same, 0.01, block=64).first().pairs == 600 * 599 // 2
    assert {(r.id, r.n) for r in dbscan.neighbour_counts(same, 0.01, block=64).collect()} == {(i, 599) for i in range(600)}


def test_clusters_of_skewed_points(spark):
    x = skewed(500)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {i: int(n) - 1 for i, n in enumerate((d <= 0.02).sum(1)) if n > 1}
    assert {r.id: r.n for r in dbscan.neighbour_counts(frame(spark, x), 0.02, block=32).collect()} == want
    whole = {r.id: (r.cluster, r.core) for r in dbscan.dbscan(frame(spark, x), 0.02, 4).collect()}
    assert {r.id: (r.cluster, r.core) for r in dbscan.dbscan(frame(spark, x), 0.02, 4, block=32).collect()} == whole


def test_lone_points_may_be_noise(spark):
    x = np.array([[0.0], [0.1], [5.0], [9.0]])
    got = {r.id: (r.cluster, r.core) for r in dbscan.dbscan(frame(spark, x), 1.0, 1, lone_is_noise=True).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (None, False), 3: (None, False)}


@pytest.mark.parametrize("dims,block", [(2, 20), (3, 512), (40, 32)])
def test_nearest_of_all_points(spark, dims, block):
    x = np.round(skewed(400, dims=dims), 3)
    x[:50] = x[0]  # equal points: ties go to the smaller id, and no cut parts them
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = knn.nearest_neighbour_join(frame(spark, x), 4, block=block).collect()
    want = {(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(r.query, r.id, r.rank) for r in got} == want
    assert all(abs(r.distance - np.sqrt(d[r.query, r.id])) < 1e-9 for r in got)
    some = knn.nearest_neighbour_join(frame(spark, x), 4, which=F.col("id") % 7 == 0, block=block).collect()
    assert {(r.query, r.id, r.rank) for r in some} == {w for w in want if w[0] % 7 == 0}


def test_few_points(spark):
    assert knn.nearest_neighbour_join(frame(spark, np.zeros((1, 2))), 3).count() == 0
    assert {(r.query, r.id) for r in knn.nearest_neighbour_join(frame(spark, np.array([[0.0], [1.0]])), 3).collect()} == {(0, 1), (1, 0)}
    empty = frame(spark, np.zeros((1, 2))).limit(0)
    assert knn.nearest_neighbour_join(empty, 3).count() == 0 and dbscan.work_of(empty, 1.0).count() == 1


def test_pairs_are_left_early():
    x = np.random.default_rng(2).normal(size=(300, 64))
    ids = np.arange(300)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, 2]
    i, j, _, terms = knn.k_best(x, ids, bound, x, ids, 3)
    assert terms < 0.85 * 300 * 299 * 64
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, int(b)) for a in range(300) for b in np.argsort(d[a], kind="stable")[:3])


def test_floats_are_sent_as_floats_and_compared_as_doubles(spark):
    x = np.random.default_rng(5).normal(size=(600, 16)).astype(np.float32)
    x[1::2] = x[::2] + np.float32(0.25) * np.eye(16, dtype=np.float32)[np.arange(300) % 16]  # pairs about at the reach
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<float>")
    assert dbscan._units(df, 0.25, "id", "features", 64).schema["x"].dataType.elementType.simpleString() == "float"
    wide = x.astype(float)
    near = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(-1) <= 0.25 * 0.25
    want = {i: int(n) for i, n in enumerate(near.sum(1) - 1) if n}
    assert {r.id: r.n for r in dbscan.neighbour_counts(df, 0.25, block=64).collect()} == want

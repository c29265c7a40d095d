"""Clusters from one pass over chunks of points, where core points of one cluster are not compared again."""

import numpy as np
import pytest

from spokeflow.operators import dbscan


def plainly(x, eps, need):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    np.fill_diagonal(near, False)
    core = near.sum(1) >= need
    cluster = np.where(core, np.arange(len(x)), len(x))
    while True:
        least = np.where(near & core[None] & core[:, None], cluster[None], len(x)).min(1, initial=len(x))
        if (least >= cluster).all():
            break
        cluster = np.minimum(cluster, least)
    border = np.where(near & core[None], cluster[None], len(x)).min(1, initial=len(x))
    cluster = np.where(core, cluster, border)
    return {i: (None if c == len(x) else int(c), bool(k)) for i, (c, k) in enumerate(zip(cluster, core))}


def mixed(n, dims, seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 1, (n // 2, dims)), r.normal(4, 0.3, (n // 4, dims)), r.uniform(-20, 20, (n - n // 2 - n // 4, dims))])
    return r.permutation(x)


@pytest.mark.parametrize("dims,eps,kind,offset,min_points,own", [
    (2, 0.5, "double", 0.0, 4, True), (2, 0.5, "double", 1e7, 1, True), (3, 1.0, "float", 0.0, 12, False), (24, 5.5, "float", 0.0, 4, False), (24, 5.5, "double", 1e6, 12, True),
])
def test_equal_to_all_pairs(spark, dims, eps, kind, offset, min_points, own):
    x = mixed(400, dims, dims) + offset
    x[7] = x[8] = x[9]
    x = x.astype(np.float32 if kind == "float" else float).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, features array<{kind}>").repartition(5)
    got = {r.id: (r.cluster, r.core) for r in dbscan.dbscan(df, eps, min_points, count_self=own, block=32).collect()}
    assert got == plainly(x, eps, min_points - own)


def test_core_points_of_a_cluster_are_not_compared_again():
    """Of 8,000 points in a ball nearly all pairs need no distance."""
    x = np.random.default_rng(1).normal(size=(8000, 16))
    reach = dbscan._Reach(x, 4.0)
    met, of = [], reach.of
    reach.of = lambda rows, columns: (met.append(len(rows) * len(columns)), of(rows, columns))[1]
    known = dbscan._Known(np.arange(8000), np.zeros(8000, np.int64), 3)
    dbscan._meet(known, reach, 8000, True)
    assert known.core.mean() > 0.95 and sum(met) < 0.35 * 8000 * 8000 / 2
    near = np.concatenate([(((x[at : at + 500, None] - x[None]) ** 2).sum(-1) <= 16.0).sum(1) - 1 for at in range(0, 8000, 500)])
    assert (known.core == (near >= 3)).all() and (known.seen[~known.core] == near[~known.core]).all()


@pytest.mark.parametrize("how", [{}, {"count_self": False}, {"lone_is_noise": True}])
def test_pairs_are_met_once_by_the_clustering(spark, monkeypatch, how):
    """Chunks travel as rows: not every point again for every block."""
    rows = []
    by_unit = dbscan._by_unit
    monkeypatch.setattr(dbscan, "_by_unit", lambda units, *a: (rows.append(units.count()), by_unit(units, *a))[1])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(3).normal(size=(1000, 12)))], "id long, features array<double>")
    assert dbscan.dbscan(df, 4.0, 4, block=32, **how).count() == 1000
    assert sum(rows) == 1000

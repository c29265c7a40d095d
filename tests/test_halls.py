"""Neighbours of all points by halls: a point goes once to each, whatever its cells."""

import numpy as np
import pytest

from spokeflow.operators import knn


@pytest.mark.parametrize("bounded", [True, False])
def test_k_near_equals_all_pairs(bounded):
    rng = np.random.default_rng(4)
    q, y = np.round(rng.normal(size=(60, 20)), 1), np.round(rng.normal(size=(5000, 20)), 1)
    y[::9] = y[0]  # ties
    ids, jds, own, cell = np.arange(60) + 10_000, rng.permutation(5000), np.arange(60) % 5, np.arange(5000) % 11
    d = ((q[:, None] - y[None]) ** 2).sum(-1)
    d[own[:, None] == cell[None]] = np.inf
    bound = np.sort(d, 1)[:, 6] if bounded else np.full(60, np.inf)
    got = knn.k_near(q, ids, bound, own, y, jds, cell, 4)
    order = [np.lexsort((jds, r))[:4] for r in d]
    assert list(zip(got[0].tolist(), got[1].tolist())) == [(int(ids[i]), int(jds[j])) for i, o in enumerate(order) for j in o]
    np.testing.assert_array_equal(got[2], [d[i, j] for i, o in enumerate(order) for j in o])


def test_a_point_goes_once_to_a_hall(spark, monkeypatch):
    seen = []
    visits = knn._visits
    monkeypatch.setattr(knn, "_visits", lambda *a: seen.append(visits(*a)) or seen[-1])
    x = np.random.default_rng(6).normal(size=(600, 30))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    assert knn.nearest_neighbour_join(df, 3, block=16).count() == 1800
    assert seen[0].groupBy("hall", "id").count().where("count > 1").count() == 0
    assert seen[0].count() <= 600 * knn.LEAST_HALLS  # not as many as cells

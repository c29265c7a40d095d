import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.operators import evaluate
from spokeflow.plans.quantiles import quantiles


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_quantiles_of_groups_of_any_size(spark, most):
    r = np.random.default_rng(4)
    groups = {"a": r.normal(size=900), "b": np.repeat([1.0, 2.0], 50), "c": np.array([7.0]), None: r.integers(0, 5, 200).astype(float)}
    rows = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("a", None, 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, _n int").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {x.g: x.q for x in quantiles(df.drop("_n"), ["g"], {"q": "v"}, shares, most).collect()}
    assert got.keys() == {*groups, "empty"} and got["empty"] is None
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, shares), rtol=0, atol=1e-12)
    every = quantiles(df.drop("_n"), [], {"q": "v"}, shares, most).first().q
    assert np.allclose(every, np.quantile(np.concatenate(list(groups.values())), shares))


def test_density_of_buckets_equals_the_sum_of_kernels(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, 500), r.uniform(-40, 60, 100), [5.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    points = np.linspace(-60, 60, 700)
    for h in (0.05, 0.5, 4.0):
        got = {p.x: p.density for p in evaluate.kernel_density(df, "v", points.tolist(), h).collect()}
        want = np.exp(-0.5 * ((points[:, None] - x) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))
        assert np.allclose([got[p] for p in points.tolist()], want, rtol=1e-11, atol=1e-16)
    assert evaluate.kernel_density(df.where(F.lit(False)), "v", [0.0]).first().density is None

"""Trailing windows taken many at a time give what each gives alone."""

import numpy as np
import pytest

from spokeflow.operators import series, signal


@pytest.mark.parametrize("x", [np.random.default_rng(1).exponential(40, 400), np.random.default_rng(2).integers(0, 4, 400) * 1.0, np.zeros(70), np.arange(5.0), np.zeros(0)])
def test_rows_equal_single_windows(x):
    for cwt in (True, False):
        got = signal.trailing_rows(x, 200, cwt)
        assert got.shape == (len(x), len(series.SERIES))
        for k, row in enumerate(got):
            want = list(signal.series_features(x[max(0, k - 200) : k + 1], cwt).values())
            np.testing.assert_allclose(row, want, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_windows_of_other_lengths_and_missing_values():
    x = np.random.default_rng(3).normal(0, 1, 300)
    np.testing.assert_allclose(signal.trailing_rows(x, 260)[-1], list(signal.series_features(x[-261:]).values()), rtol=1e-9)
    gaps = np.array([None if k % 7 == 3 or k < 2 else v for k, v in enumerate(x)], object)
    got = signal.trailing_rows(gaps, 50)
    for k in (0, 1, 2, 40, 299):
        want = signal.series_features(np.array([v for v in gaps[max(0, k - 50) : k + 1] if v is not None], float))
        np.testing.assert_allclose(got[k], list(want.values()), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_values_travel_once(spark):
    df = spark.range(100).selectExpr("'a' as run", "id as t", "case when id % 9 > 0 then id % 5 end as v")
    out = series.trailing_series(df, "v", ["run"], ["t"], rows=20)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = [k % 5 if k % 9 else None for k in range(100)]
    for r in out.where("t in (0, 50, 99)").collect():
        want = signal.series_features(np.array([u for u in v[max(0, r.t - 20) : r.t + 1] if u is not None], float))
        assert [x is None for x in r[2:]] == [np.isnan(x) for x in want.values()]
        np.testing.assert_allclose([x for x in r[2:] if x is not None], [x for x in want.values() if not np.isnan(x)], atol=1e-12)

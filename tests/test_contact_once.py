"""Contact pixels are found once for all that is read off them."""

import numpy as np


def test_contact_is_found_once(spark, monkeypatch):
    from spokeflow.operators import frames
    from spokeflow.plans import lifecycle

    seen, geometry = [], frames.geometry
    monkeypatch.setattr(frames, "geometry", lambda marked, *a: seen.append(marked) or geometry(marked, *a))

    rows = []
    for i in range(200):
        t = i * 0.05
        rows += [("r", "rho", t, (i * 3.0) % 360), ("r", "current", t, 0.0 if i < 20 else 1.0), ("r", "slip", t, 0.1)]
    samples = spark.createDataFrame(rows, "run_id string, channel string, ts double, value double")
    binned = lifecycle.unify(samples)
    assert {"rho", "slip", "sink", "current", "imu_bin"} <= set(binned.columns)
    r = np.random.default_rng(0)
    px = [("r", int(b), y, x, float(r.exponential())) for b in range(0, 99, 9) for y in range(4) for x in range(96)]
    lifecycle.featurise(binned, spark.createDataFrame(px, "run_id string, bin long, row int, col int, p double"))
    assert len(seen) == 1 and "percentile" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()

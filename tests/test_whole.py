"""Registered queries take all rows of their tables."""

import pytest


@pytest.mark.parametrize("n_frames", [7, 5000])
def test_lifecycle_takes_all_runs_and_frames(spark, tmp_path, n_frames):
    from pyspark.sql import functions as F

    from spokeflow.plans import lifecycle
    from spokeflow.queries import models

    e = spark.range(4000).select(
        F.col("id").alias("event_id"), (F.col("id") % 200).alias("user_id"), F.array(*map(F.lit, ("click", "view", "purchase", "error")))[(F.col("id") % 200 + F.floor(F.col("id") / 200)).cast("int") % 4].alias("event_type"),
        (F.col("id") % 97 + 1).cast("double").alias("value"), F.timestamp_seconds(1.7e9 + F.col("id") * 60.0).alias("ts"), F.lit("{}").alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    v = spark.range(n_frames).select((F.col("id") * 3).alias("vec_id"), F.array_repeat(F.col("id").cast("float") + 1, 64).alias("embedding"))
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    whole = lifecycle.featurise
    lifecycle.featurise = lambda binned, pixels, **k: (seen.append((binned, pixels)), whole(binned, pixels, **k))[1]
    try:
        out = models.lifecycle_features(spark, str(tmp_path))
    finally:
        lifecycle.featurise = whole
    pixels = seen[0][1].where("row = 0 and col = 0").cache()
    assert out.select("run_id").distinct().count() == 200 and out.where("npix_all is null").count() == 0
    assert pixels.count() == out.count() == pixels.select("run_id", "bin").distinct().count()
    total, least, most = pixels.agg(F.sum("p"), F.min("p"), F.max("p")).first()
    if n_frames == 7:
        assert pixels.select("p").distinct().count() == 7
    else:
        frames = n_frames / out.count()
        assert frames > 1 and abs(total / 100 / out.count() / ((n_frames + 1) / 2) - 1) < 0.05
    assert models.lifecycle_predictions(spark, str(tmp_path)).count() > 0 if n_frames == 7 else True


def test_wavelet_features_of_all_events(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from spokeflow import catalog
    from spokeflow.operators import series, signal

    kinds = ("click", "error", "view")
    e = spark.range(720).select(
        F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.array(*map(F.lit, kinds))[(F.col("id") % 3).cast("int")].alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) * 1.0).alias("value"), F.timestamp_seconds(1.7e9 + F.col("id") * 60.0).alias("ts"), F.lit("{}").alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.event_type, round((r.t - 1.7e9) / 60)): [r[n] for n in series.SERIES] for r in catalog.queries()["trailing_wavelet_features"](spark, str(tmp_path)).collect()}
    rows = sorted((r.event_id, r.event_type, r.value) for r in e.collect())
    assert len(got) == 720
    for kind in kinds:
        own = [(i, v) for i, k, v in rows if k == kind]
        for k, (i, _) in enumerate(own):
            want = signal.series_features(np.array([v for _, v in own[max(0, k - 200) : k + 1]]))
            np.testing.assert_allclose(np.array(got[kind, i], float), [want[n] for n in series.SERIES], equal_nan=True)

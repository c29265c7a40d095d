"""The slip model of the lifecycle is fitted with all trees of the published one."""

from pyspark.sql import functions as F


def test_slip_model_has_all_trees(spark, monkeypatch):
    from spokeflow.queries import models

    names = ["npix_all", "area_ratio", "sink_mean", "sink_std", "sink_diff_angle_mean", "sink_theta_m"]
    rows = spark.range(120).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("t"), (F.col("id") % 11 / 11).alias("slip"), *[(F.col("id") * (k + 3) % 17).cast("double").alias(n) for k, n in enumerate(names)])
    monkeypatch.setattr(models, "_lifecycle", lambda *_: rows)
    trees, fitted, regressor, predicted = [], [], models.ml.regressor, models.ml.predicted

    def short(*a, **k):
        model = regressor(*a, **k)
        gbt = model.getStages()[-1]
        trees.append(gbt.getMaxIter())
        gbt.setMaxIter(2)  # what was asked for is seen, and takes long
        return model

    monkeypatch.setattr(models.ml, "regressor", short)
    monkeypatch.setattr(models.ml, "predicted", lambda model, *a: (fitted.append(model), predicted(model, *a))[1])
    assert models.lifecycle_predictions(spark, "").count() > 100
    assert trees == [600] and fitted[0].stages[-1].getNumTrees == 2

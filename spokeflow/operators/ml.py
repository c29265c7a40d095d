"""Tree ensembles with cross-validation by run, and prediction with features aligned by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.functions.scalars import blind_spot
from spokeflow.operators.assemble import aligned, group_folds
from spokeflow.plans.lineage import written
from spokeflow.plans.spread import numbered

SEED = 5432


def regressor(features: Sequence[str], label: str = "label", trees: int = 600, depth: int = 4, leaf: int = 100, seed: int = SEED) -> Pipeline:
    """Boosted regression trees on half the rows and a third of the features a tree."""
    gbt = GBTRegressor(
        featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, subsamplingRate=0.5, minInstancesPerNode=leaf,
        featureSubsetStrategy="onethird", seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), gbt])


def boosted_classifier(features: Sequence[str], label: str = "label", trees: int = 50, depth: int = 4, leaf: int = 100, seed: int = SEED) -> Pipeline:
    """Boosted trees of two classes, one against the rest for more."""
    gbt = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, subsamplingRate=0.5, minInstancesPerNode=leaf,
        featureSubsetStrategy="onethird", seed=seed,
    )
    rest = OneVsRest(classifier=gbt, featuresCol="_features", labelCol=label)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), rest])


def forest_classifier(features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 12, leaf: int = 1, seed: int = SEED) -> Pipeline:
    rf = RandomForestClassifier(
        featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="0.33", seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), rf])


def out_of_fold(df: DataFrame, estimator, group: str, folds: int = 10, seeds: Sequence[int] = (SEED,)) -> DataFrame:
    """Predictions for every row by a model that saw no row of its group, one set per seed."""
    rows = written(df.join(group_folds(df, group, folds), group))
    return _over_folds(rows, estimator, folds, seeds)


def _over_folds(rows: DataFrame, estimator, folds: int, seeds: Sequence[int]) -> DataFrame:
    """Each fold's rows by a model that was fitted on the others, one set per seed."""
    out = None
    for seed in seeds:
        for fold in range(folds):
            stage = estimator.getStages()[-1]
            stage = stage.getClassifier() if isinstance(stage, OneVsRest) else stage
            stage.setSeed(seed)
            model = estimator.fit(rows.where(F.col("fold") != fold))
            part = model.transform(rows.where(F.col("fold") == fold)).withColumn("seed", F.lit(seed))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stratified_folds(df: DataFrame, label: str, folds: int = 3, seed: int = SEED, key: str = "id") -> DataFrame:
    """Adds fold: rows of each label in the order of a seeded MD5 of their key, dealt in turn, so folds of a label differ by one row at most.

    Labels of any number of rows are numbered by ranges, not sorted in one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rows = numbered(df.withColumn("_h", h), [label], ["_h", key])
    return rows.withColumn("fold", (F.col("_rn") % folds).cast("int")).drop("_h", "_rn", "_n")


def without_angle(df: DataFrame, angle: str, degrees: Sequence[float] = (270.0,)) -> DataFrame:
    """Rows taken at none of these wheel angles; a missing angle stays."""
    return df.where(~F.coalesce(F.col(angle).isin(*degrees), F.lit(False)))


def out_of_stratum(df: DataFrame, estimator, label: str, folds: int = 3, seeds: Sequence[int] = tuple(range(SEED, SEED + 20)), key: str = "id") -> DataFrame:
    """Predictions for every row by a model that did not see it, over folds that hold each label alike, dealt anew for each seed."""
    out = None
    for seed in seeds:
        part = _over_folds(written(stratified_folds(df, label, folds, seed, key)), estimator, folds, [seed])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def predicted(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for every row, with the model's features picked by name; a missing feature column is an error.

    A row with a missing number has no prediction: NaN, and no probability.
    """
    aligned(df, features)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in features])
    filled = df.withColumn("_whole", whole).withColumns({c: F.when(F.col("_whole"), F.col(c).cast("double")).otherwise(0.0) for c in features})
    out = model.transform(filled)
    out = out.withColumn("prediction", F.when(F.col("_whole"), F.col("prediction")).otherwise(F.lit(float("nan"))))
    if "probability" not in out.columns:
        return out.select(*keep, "prediction")
    return out.withColumn("probability", F.when(F.col("_whole"), F.col("probability"))).select(*keep, "prediction", "probability")


def save_model(model: PipelineModel, path: str) -> None:
    """One fitted model at a path, in place of what stood there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_rock(df: DataFrame, probability: str = "probability") -> DataFrame:
    """The probability of a rock, class 1."""
    return df.withColumn("rock", vector_to_array(probability)[1])


def with_class(df: DataFrame, names: Sequence[str], probability: str = "probability") -> DataFrame:
    """The largest class probability and the name at its position (the first on ties)."""
    p = vector_to_array(probability)
    best = F.array_max(p)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(p, best).cast("int"))
    return df.withColumns({"confidence": best, "class": name})


def hydration(df: DataFrame, angle: str, probability: str = "probability") -> DataFrame:
    """P(dry), the largest probability and the level, missing in the blind spot of the wheel."""
    p = vector_to_array(probability)
    best = F.array_max(p)
    hide = lambda c: blind_spot(c, F.col(angle))
    return df.withColumns({"p_dry": hide(p[0]), "p_max": hide(best), "level": hide((F.array_position(p, best) - 1).cast("double"))})


def surface(_: DataFrame) -> Column:
    """The surface model is a stub without an answer."""
    return F.lit(float("nan"))


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features with their importance, the largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values), key=lambda x: (-x[1], x[0]))


def eliminated(df: DataFrame, build, features: Sequence[str], keep: int, step: int = 1) -> list[str]:
    """Recursive elimination: refit and drop the least important features until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        ranked = importances(build(left).fit(df), left)
        left = [f for f, _ in ranked[: max(keep, len(left) - step)]]
    return sorted(left)

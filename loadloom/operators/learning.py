"""Regressions, boosting, spatial blocks and searches with folds by group, on Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame


def features(columns: Sequence[str], scaled: bool = True) -> list:
    """Stages that fill gaps with medians, gather the columns and scale them."""
    filled = [f"_{c}" for c in columns]
    stages = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw" if scaled else "_features")]
    return [*stages, StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)] if scaled else stages


def learner(kind: str, label: str, **options):
    """ols, ridge, lasso, elastic net or boosted trees."""
    mixes = {"ols": 0.0, "ridge": 0.0, "lasso": 1.0, "elastic": 0.5}
    if kind == "boosted":
        return GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="predicted", seed=7, **{"maxIter": 20, **options})
    penalty = 0.0 if kind == "ols" else options.get("penalty", 0.1)
    return LinearRegression(featuresCol="_features", labelCol=label, predictionCol="predicted", regParam=penalty, elasticNetParam=mixes[kind])


def fit(df: DataFrame, columns: Sequence[str], label: str, kind: str, scaled: bool = True, **options):
    return Pipeline(stages=[*features(columns, scaled), learner(kind, label, **options)]).fit(df.where(f"{label} IS NOT NULL"))


def spatial_blocks(df: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """A block for each row by its coordinates, to hold out areas rather than rows."""
    gathered = VectorAssembler(inputCols=list(columns), outputCol="_at").transform(df)
    return KMeans(k=blocks, seed=7, featuresCol="_at", predictionCol="block").fit(gathered).transform(gathered).drop("_at")


def search(df: DataFrame, columns: Sequence[str], label: str, penalties: Sequence[float], folds: int, fold: str = "fold") -> tuple[float, list[float]]:
    """The ridge penalty with the least RMSE over folds that are given, so that a group is never split, and all of their RMSEs."""
    ridge = learner("ridge", label)
    grid = ParamGridBuilder().addGrid(ridge.regParam, list(penalties)).build()
    judge = RegressionEvaluator(labelCol=label, predictionCol="predicted", metricName="rmse")
    cv = CrossValidator(estimator=Pipeline(stages=[*features(columns), ridge]), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol=fold)
    means = [float(x) for x in cv.fit(df).avgMetrics]
    return penalties[means.index(min(means))], means

"""Models over wide feature frames: L1 regression, logistic regression, forests, boosting; fitting, scoring, coefficients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assembled(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(metrics), outputCol="features", handleInvalid="error").transform(frame)


def contiguous_folds(frame: DataFrame, folds: int, order: str = "win") -> DataFrame:
    """Fold numbers by position, as unshuffled k-fold splits do; one row a window, so the frame is small."""
    return frame.withColumn("fold", (F.ntile(folds).over(Window.orderBy(order)) - 1).cast("int"))


def lasso(frame: DataFrame, metrics: Sequence[str], label: str = "label", folds: int = 5, strengths: Sequence[float] = (0.001, 0.003, 0.01, 0.03, 0.1), order: str = "win"):
    """L1 linear regression, its strength by cross-validation over contiguous folds."""
    model = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0, standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).build()
    data = contiguous_folds(assembled(frame, metrics), folds, order)
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mse"), numFolds=folds, foldCol="fold").fit(data).bestModel


def logistic(frame: DataFrame, metrics: Sequence[str], label: str = "label", l1: bool = False, strength: float = 0.01):
    return LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=float(l1), regParam=strength).fit(assembled(frame, metrics))


def forest(frame: DataFrame, metrics: Sequence[str], label: str = "label", trees: int = 20, bagging: bool = False, seed: int = 0):
    """Random forest; with bagging all features at each split."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, featureSubsetStrategy="all" if bagging else "auto", seed=seed).fit(assembled(frame, metrics))


class AdaBoost:
    """SAMME for two classes over decision stumps with row weights."""

    def __init__(self, rounds: int = 10, depth: int = 1):
        self.rounds, self.depth, self.models = rounds, depth, []

    def fit(self, frame: DataFrame, metrics: Sequence[str], label: str = "label") -> AdaBoost:
        data = assembled(frame, metrics).withColumn("_w", F.lit(1.0))
        for _ in range(self.rounds):
            tree = DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol="_w", maxDepth=self.depth, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q").fit(data)
            out = tree.transform(data)
            wrong = F.col("_p") != F.col(label)
            err = out.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
            if err is None or err >= 0.5:
                break
            alpha = math.log((1 - err) / max(err, 1e-10))
            self.models.append((alpha, tree))
            if err == 0:
                break
            data = out.withColumn("_w", F.col("_w") * F.when(wrong, math.exp(alpha)).otherwise(1.0)).drop("_p", "_r", "_q")
        return self

    def score(self, frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
        out, total, score = assembled(frame, metrics), sum(a for a, _ in self.models) or 1.0, F.lit(0.0)
        for k, (alpha, tree) in enumerate(self.models):
            out = tree.copy({tree.predictionCol: f"_p{k}", tree.rawPredictionCol: f"_r{k}", tree.probabilityCol: f"_q{k}"}).transform(out)
            score = score + alpha / total * F.col(f"_p{k}")
        return out.withColumn("score", score).drop("features", *(f"_{x}{k}" for x in "prq" for k in range(len(self.models))))


def class_one(probability: Column | str) -> Column:
    """The probability of class 1; 0 where trees knew class 0 alone, whose probabilities have one place."""
    return F.coalesce(F.get(vector_to_array(probability), F.lit(1)), F.lit(0.0))


def scored(model, frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """frame with score: the prediction of a regression, the probability of class 1 of a classifier."""
    if hasattr(model, "scored"):
        return model.scored(frame)
    out = model.transform(assembled(frame, metrics))
    value = class_one("probability") if "probability" in out.columns else F.col("prediction")
    return out.withColumn("score", value).select(*frame.columns, "score")


def coefficients(spark: SparkSession, model, metrics: Sequence[str]) -> DataFrame:
    rows = [(m, float(c)) for m, c in zip(metrics, model.coefficients)] + [("intercept", float(model.intercept))]
    return spark.createDataFrame(rows, "metric string, coef double")


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tuned_logistic(frame: DataFrame, metrics: Sequence[str], label: str = "label", l1: bool = False, folds: int = 3, strengths: Sequence[float] = (0.001, 0.01, 0.1), order: str = "win"):
    """Logistic regression whose strength comes from cross-validation over contiguous folds."""
    model = LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=float(l1))
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).build()
    data = contiguous_folds(assembled(frame, metrics), folds, order)
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, foldCol="fold").fit(data).bestModel


def boosted(frame: DataFrame, metrics: Sequence[str], label: str = "label", rounds: int = 10, depth: int = 2, seed: int = 0):
    """Gradient-boosted trees with the logistic loss."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).fit(assembled(frame, metrics))


def lasso_path(frame: DataFrame, metrics: Sequence[str]):
    from .lasso import Lasso

    return Lasso.fit(frame, metrics)


def boosted_by(kind: str, learner: str, rounds: int = 10):
    """The forms of AdaBoost: R2 over trees or Lasso, SammeR over stumps or logistic regression."""

    def fit(frame: DataFrame, metrics: Sequence[str]):
        from . import boosting

        return getattr(boosting, kind)(getattr(boosting, learner)(), rounds).fit(frame, metrics)

    return fit


def extra_trees(frame: DataFrame, metrics: Sequence[str]):
    from .trees import ExtraTrees

    return ExtraTrees().fit(frame, metrics)


#: The models of a grid by name: each fits a wide frame and returns what scores one.
GRID = {
    "lasso": lambda f, m: lasso(f, m, folds=3),
    "lasso_path": lasso_path,
    "boosting_lasso": boosted_by("R2", "lasso"),
    "boosting_regressor": boosted_by("R2", "tree"),
    "boosting_logistic": boosted_by("SammeR", "logistic"),
    "boosting_classifier": boosted_by("SammeR", "stump"),
    "extra_trees": extra_trees,
    "logistic": logistic,
    "logistic_l1": lambda f, m: logistic(f, m, l1=True),
    "logistic_cv": tuned_logistic,
    "forest": forest,
    "bagging": lambda f, m: forest(f, m, bagging=True),
    "boosting": boosted,
}


def fit_grid(frames: dict[int, DataFrame], metrics: Sequence[str], names: Sequence[str] = tuple(GRID), train: str = "is_test = 0") -> dict:
    """(granularity, model name) -> the fitted model, each on its granularity's training rows."""
    return {(g, n): GRID[n](f.filter(train), metrics) for g, f in frames.items() for n in names}


def score_grid(fitted: dict, frames: dict[int, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """(gran, model, win, label, is_test, score): models on the rows of frames, of the run that they were fitted on or of another one."""
    parts = [scored(model, frames[g], metrics).select(F.lit(g).alias("gran"), F.lit(n).alias("model"), "win", "label", "is_test", "score") for (g, n), model in fitted.items() if g in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

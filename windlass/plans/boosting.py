"""AdaBoost over weighted learners: R2 for regression (trees or Lasso), SAMME.R for two classes (stumps or logistic regression).

Every round is one fit with row weights and one pass that sums the weighted losses; the weights are a column, written after
each round, so that the plan doesn't grow. Learners see the weights themselves, in place of a draw of rows by them, so a
fit has no chance in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.ranks import contiguous_folds
from .lasso import Lasso, grams
from .models import assembled, class_one

#: A learner's fit: (frame with features, label and weight) -> (frame -> frame with the prediction in a named column).
Apply = Callable[[DataFrame, str], DataFrame]


def _transformer(model, name: str, column: Callable[[str], Column]) -> Apply:
    """A fitted model of MLlib, whose own columns don't stay."""
    own = {p: f"_{p.name}" for p in (getattr(model, n, None) for n in ("predictionCol", "rawPredictionCol", "probabilityCol")) if p is not None}

    def run(frame: DataFrame, out: str) -> DataFrame:
        return model.copy(own).transform(frame).withColumn(out, column(name)).drop(*own.values())

    return run


def tree(depth: int = 3, seed: int = 0):
    """Regression trees over all rows."""
    def fit(frame: DataFrame, metrics: Sequence[str], label: str, weight: str) -> Apply:
        model = DecisionTreeRegressor(featuresCol="features", labelCol=label, weightCol=weight, maxDepth=depth, seed=seed).fit(frame)
        return _transformer(model, "_predictionCol", F.col)

    return fit


def lasso(folds: int = 5, n: int = 100):
    """L1 regression whose strength is chosen anew by each round's weights; frame has a fold."""
    def fit(frame: DataFrame, metrics: Sequence[str], label: str, weight: str) -> Apply:
        model = Lasso.of(*grams(frame, metrics, label, "fold", weight), metrics, folds, n)
        return lambda f, out: model.scored(f).withColumnRenamed("score", out)

    return fit


def stump(depth: int = 1, seed: int = 0):
    def fit(frame: DataFrame, metrics: Sequence[str], label: str, weight: str) -> Apply:
        model = DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol=weight, maxDepth=depth, seed=seed).fit(frame)
        return _transformer(model, "_probabilityCol", class_one)

    return fit


def logistic(strength: float = 0.01):
    """Logistic regression with an L2 penalty."""
    def fit(frame: DataFrame, metrics: Sequence[str], label: str, weight: str) -> Apply:
        model = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, regParam=strength).fit(frame)
        return _transformer(model, "_probabilityCol", class_one)

    return fit


class R2:
    """AdaBoost.R2 with the linear loss (Drucker 1997): the weighted median of the learners."""

    def __init__(self, learner, rounds: int = 10):
        self.learner, self.rounds, self.fitted = learner, rounds, []

    def fit(self, frame: DataFrame, metrics: Sequence[str], label: str = "label", folds: int = 5, order: Sequence[str] = ("win",)) -> R2:
        """A row's loss is its error by the largest of all; a learner of mean loss of a half or more ends the rounds."""
        self.metrics = list(metrics)
        rows = contiguous_folds(frame, folds, order)
        data = cut(assembled(rows, metrics).withColumn("_w", F.lit(1.0)))
        for _ in range(self.rounds):
            apply = self.learner(data, metrics, label, "_w")
            out = apply(data, "_p").withColumn("_e", F.abs(F.col("_p") - F.col(label)))
            most = out.agg(F.max("_e")).first()[0]
            if most is None:
                break
            if most == 0:
                self.fitted.append((1.0, apply))
                break
            total, lost, n = out.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_e") / most), F.count("*")).first()
            mean = lost / total
            if mean >= 0.5:
                if not self.fitted:
                    self.fitted.append((1.0, apply))
                break
            beta = mean / (1 - mean)
            self.fitted.append((math.log(1 / beta), apply))
            # weights are kept at a mean of 1
            data = out.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / most)).drop("_p", "_e")
            scale = n / data.agg(F.sum("_w")).first()[0]
            data = cut(data.withColumn("_w", F.col("_w") * scale))
        return self

    def scored(self, frame: DataFrame) -> DataFrame:
        """frame with score: of the predictions in order, the first at which the learners' weights reach half of all."""
        out, pairs = assembled(frame, self.metrics), []
        for k, (weight, apply) in enumerate(self.fitted):
            out = apply(out, f"_p{k}")
            pairs.append(F.struct(F.col(f"_p{k}").alias("p"), F.lit(float(weight)).alias("w")))
        half = sum(w for w, _ in self.fitted) / 2
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
        step = lambda acc, x: F.when(acc["p"].isNotNull(), acc).otherwise(F.struct((acc["w"] + x["w"]).alias("w"), F.when(acc["w"] + x["w"] >= half * (1 - 1e-12), x["p"]).alias("p")))
        return out.withColumn("score", F.aggregate(F.sort_array(F.array(*pairs)), start, step)["p"]).select(*frame.columns, "score")


class SammeR:
    """SAMME.R for two classes (Zhu et al. 2009): learners' log odds add up."""

    def __init__(self, learner, rounds: int = 10):
        self.learner, self.rounds, self.fitted = learner, rounds, []

    def fit(self, frame: DataFrame, metrics: Sequence[str], label: str = "label") -> SammeR:
        self.metrics = list(metrics)
        data = cut(assembled(frame, metrics).withColumn("_w", F.lit(1.0)))
        for _ in range(self.rounds):
            apply = self.learner(data, metrics, label, "_w")
            self.fitted.append(apply)
            out = apply(data, "_p")
            wrong, total, n = out.agg(F.sum(F.when((F.col("_p") > 0.5) != (F.col(label) > 0.5), F.col("_w")).otherwise(0.0)), F.sum("_w"), F.count("*")).first()
            if not wrong:
                break
            sign = F.when(F.col(label) > 0.5, 1.0).otherwise(-1.0)
            data = out.withColumn("_w", F.col("_w") * F.exp(-0.5 * sign * _log_odds("_p"))).drop("_p")
            scale = n / data.agg(F.sum("_w")).first()[0]
            data = cut(data.withColumn("_w", F.col("_w") * scale))
        return self

    def scored(self, frame: DataFrame) -> DataFrame:
        """frame with score: the probability of class 1, from the mean of the learners' log odds."""
        out = assembled(frame, self.metrics)
        for k, apply in enumerate(self.fitted):
            out = apply(out, f"_p{k}")
        mean = reduce(lambda a, b: a + b, (_log_odds(f"_p{k}") for k in range(len(self.fitted)))) / len(self.fitted)
        return out.withColumn("score", 1 / (1 + F.exp(-mean))).select(*frame.columns, "score")


def _log_odds(p: str) -> Column:
    least = 2.220446049250313e-16
    p = F.least(F.greatest(F.col(p), F.lit(least)), F.lit(1 - least))
    return F.log(p / (1 - p))

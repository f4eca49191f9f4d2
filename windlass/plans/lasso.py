"""L1 linear regression along a path of strengths, chosen by cross-validation over contiguous folds.

The rows are read twice, for the means and for the sums of products of each fold (a Gram matrix of the metrics, the label
and 1, summed up by tasks and then by a grouped sum). All else needs only these: the fits of all strengths on all folds
need no row again (active-set steps in covariance form), and a fold's squared error is a form in its own Gram matrix. With p metrics
and k folds the driver has k * (p + 2)^2 numbers, at most MAX_METRICS metrics, whatever the number of rows.

A fit minimises |y - Xw - b|^2 / (2 n) + strength * |w|_1. The path starts at the least strength at which all of w is
0 and goes down to eps of it; the strength of least mean error over the folds counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.ranks import contiguous_folds

MAX_METRICS = 512


def _summer(means: np.ndarray):
    """(fold, i, j, sum) of a task's rows (fold, z, weight)."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - means
            z = np.column_stack([np.ones(len(z)), z])
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = z[fold == f]
                held[int(f)] = held.get(int(f), 0) + (part * weight[fold == f, None]).T @ part
        for f, g in sorted(held.items()):
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["fold", "i", "j", "s"])

    return run


def grams(frame: DataFrame, metrics: Sequence[str], label: str, fold: str, weight: str | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Means of metrics and label, and by fold the sums of products of (1, metrics, label), less their means, each row with its weight."""
    columns = [*metrics, label]
    if len(metrics) > MAX_METRICS:
        raise ValueError(f"{len(metrics)} metrics; at most {MAX_METRICS}")
    means = np.array([np.nan if v is None else v for v in frame.agg(*(F.avg(F.col(f"`{c}`").cast("double")) for c in columns)).first()], float)
    z = frame.select(F.col(fold).cast("int").alias("fold"), F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("z"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    made = z.mapInArrow(_summer(means), "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    out: dict[int, np.ndarray] = {}
    for f, i, j, s in zip(*(made.column(k).to_pylist() for k in range(4))):
        g = out.setdefault(f, np.zeros((len(columns) + 1,) * 2))
        g[i, j] = g[j, i] = s
    if any(not np.isfinite(g).all() for g in out.values()):
        raise ValueError("a metric or the label is null or not a number in some row")
    return means, out


def _moments(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """Rows, means of metrics and label, and the metrics' products among themselves and with the label about the means, by row."""
    n, x, y = g[0, 0], g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
    return n, x, y, g[1:-1, 1:-1] / n - np.outer(x, x), g[1:-1, -1] / n - x * y


def descend(q: np.ndarray, c: np.ndarray, strength: float, w: np.ndarray) -> np.ndarray:
    """The w of least w'Qw / 2 - c'w + strength * |w|_1, from a start, by search over the signs of the metrics in use.

    With their signs fixed, the metrics in use have an exact solution; the way to it ends where one of them gets to 0, which
    is then left out. When none does, the metric whose slope is furthest over the strength comes in. Dependent metrics make
    no trouble: along directions that change nothing else, the sum of weights shrinks until one of them is 0.
    """
    w = w.copy()
    diagonal = np.diag(q)
    free = diagonal > 1e-12 * max(diagonal.max(initial=0.0), 1e-300)  # constant metrics stay 0
    sign, slack = np.sign(w), 1e-9 * max(strength, 1e-6 * np.abs(c).max(initial=0.0))
    for _ in range(50 * len(c) + 50):
        while len(used := np.flatnonzero(sign)):
            part, goal = q[np.ix_(used, used)], c[used] - strength * sign[used]
            there = np.linalg.lstsq(part, goal, rcond=1e-10)[0]
            rest = goal - part @ there
            endless = np.abs(rest).max() > slack
            step = rest if endless else there - w[used]
            # how far until a weight has its sign no more
            back = step * sign[used] < 0
            far = np.where(back, np.abs(w[used]) / np.where(back, np.abs(step), 1.0), np.inf)
            k = int(far.argmin())
            if not endless and far[k] >= 1:
                w[used] = there
                break
            if not np.isfinite(far[k]):  # only by rounding: a direction that changes nothing
                break
            w[used] += far[k] * step
            w[used[k]] = sign[used[k]] = 0.0
        slope = np.where(free & (sign == 0), c - q @ w, 0.0)
        j = int(np.abs(slope).argmax()) if len(slope) else 0
        if not len(slope) or abs(slope[j]) <= strength + slack:
            break
        sign[j] = np.sign(slope[j])
    return w


def strengths(c: np.ndarray, n: int = 100, eps: float = 1e-3) -> np.ndarray:
    top = np.abs(c).max(initial=0.0)
    return np.geomspace(top, top * eps, n) if top > 0 else np.zeros(1)


class Lasso:
    """A fitted model: coef by metric, intercept, and the path's strengths with their mean errors."""

    def __init__(self, metrics: Sequence[str], coef: np.ndarray, intercept: float, strength: float, path: list[tuple[float, float]]):
        self.metrics, self.coef, self.intercept, self.strength, self.path = list(metrics), coef, intercept, strength, path

    @staticmethod
    def fit(frame: DataFrame, metrics: Sequence[str], label: str = "label", folds: int = 5, order: Sequence[str] = ("win",), n: int = 100, eps: float = 1e-3, weight: str | None = None) -> Lasso:
        """Empty frames and folds without rows are errors; a row of weight 2 counts as two."""
        data = contiguous_folds(frame.select(*order, *(F.col(f"`{m}`") for m in metrics if m not in order), label, *([weight] if weight else [])), folds, order)
        return Lasso.of(*grams(data, metrics, label, "fold", weight), metrics, folds, n, eps)

    @staticmethod
    def of(means: np.ndarray, by_fold: dict[int, np.ndarray], metrics: Sequence[str], folds: int, n: int = 100, eps: float = 1e-3) -> Lasso:
        if len(by_fold) < folds:
            raise ValueError(f"fewer rows than {folds} folds")
        every = sum(by_fold.values())
        rows, x, y, q, c = _moments(every)
        path = strengths(c, n, eps)
        errors = np.zeros(len(path))
        for g in by_fold.values():
            _, tx, ty, tq, tc = _moments(every - g)
            w = np.zeros(len(c))
            for k, a in enumerate(path):
                w = descend(tq, tc, a, w)
                # of the fold's rows, the mean of (y - b - xw)^2 as a form in its Gram matrix
                v = np.concatenate([[-(ty - tx @ w)], -w, [1.0]])
                errors[k] += v @ g @ v / g[0, 0] / len(by_fold)
        best = int(errors.argmin())
        w = np.zeros(len(c))
        for a in path[: best + 1]:
            w = descend(q, c, a, w)
        return Lasso(metrics, w, float(means[-1] + y - (x + means[:-1]) @ w), float(path[best]), list(zip(path.tolist(), errors.tolist())))

    def scored(self, frame: DataFrame) -> DataFrame:
        """frame with score; metrics without weight aren't read."""
        parts = [F.col(f"`{m}`") * float(w) for m, w in zip(self.metrics, self.coef) if w]
        return frame.withColumn("score", reduce(lambda a, b: a + b, parts, F.lit(self.intercept)))

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table that load reads again."""
        row = (self.metrics, [float(c) for c in self.coef], self.intercept, self.strength, [list(p) for p in self.path])
        spark.createDataFrame([row], "metrics array<string>, coef array<double>, intercept double, strength double, path array<array<double>>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Lasso:
        r = spark.read.parquet(path).first()
        return Lasso(r.metrics, np.array(r.coef), r.intercept, r.strength, [tuple(p) for p in r.path])

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*zip(self.metrics, map(float, self.coef)), ("intercept", self.intercept)], "metric string, coef double")


def rebucketed_scores(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, win, metric, value): of scores (*keys, gran, win, score), each granularity's greatest in every window of the largest granularity.

    Windows of the largest granularity that a finer one doesn't reach wholly are still its own.
    """
    top = scores.agg(F.max("gran")).first()[0]
    return scores.groupBy(*keys, F.floor(F.col("win") / F.floor(F.lit(top) / F.col("gran"))).alias("win"), F.col("gran").cast("string").alias("metric")).agg(F.max("score").alias("value"))


def multi_granularity(frames: dict[int, DataFrame], metrics: Sequence[str], label: str = "label", train: str = "is_test = 0", folds: int = 5, refit_folds: int = 3) -> tuple[Lasso, dict[int, Lasso], DataFrame]:
    """Models by granularity, a model over their scores at the largest one, and the scored rows (win, label, is_test, a column by granularity, score).

    frames: by granularity (win, label, is_test, metrics). Scores are re-bucketed to the largest granularity by their maximum;
    its labels count.
    """
    fitted = {g: Lasso.fit(f.filter(train), metrics, label, folds) for g, f in frames.items()}
    parts = [fitted[g].scored(f).select(F.lit(g).alias("gran"), "win", "score") for g, f in frames.items()]
    names, top = [str(g) for g in sorted(frames)], max(frames)
    wide = rebucketed_scores(reduce(DataFrame.unionByName, parts)).groupBy("win").pivot("metric", names).agg(F.max("value"))
    rows = cut(frames[top].select("win", label, "is_test").join(wide, "win").dropna(subset=names))
    last = Lasso.fit(rows.filter(train), names, label, refit_folds)
    return last, fitted, last.scored(rows)

"""Training on the lowest rate at which each path is still detected."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .lasso import Lasso
from .scoring import confusion, lowest_rates, operating_points, rates, roc_points


def lowered(rows: DataFrame, chosen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of the largest rate, each path's replaced by those of its chosen rate (*keys, path, rate).

    Rows without a path, and those of paths that have no choice, stay as they are at the largest rate of their keys. One pass
    over the rows: the choices are a row a path.
    """
    top = (rows.groupBy(*keys) if keys else rows).agg(F.max("rate").alias("_top"))
    c = chosen.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("path").alias("_path"), F.col("rate").alias("_chosen"))
    out = rows.join(top, list(keys)) if keys else rows.crossJoin(F.broadcast(top))
    out = out.join(c, [F.col("path") == F.col("_path"), *(F.col(k) == F.col(f"_k_{k}") for k in keys)], "left")
    return out.filter(F.col("rate") == F.coalesce("_chosen", "_top")).select(*rows.columns)


def detected(scores: DataFrame, share: float) -> DataFrame:
    """(path, rate, tpr) of test rows (rate, path, label, score), each rate at its threshold of at most a share of false positives."""
    at = operating_points(roc_points(scores, ["rate"]), share, ["rate"]).select("rate", "thr")
    # the curve's points take scores from the threshold on, so does this
    pred = scores.join(at, "rate").withColumn("pred", (F.col("score") >= F.col("thr")).cast("int"))
    return rates(confusion(pred.filter("label = 1"), ["rate", "path"])).select("path", "rate", "tpr")


def retrained(rows: DataFrame, metrics: Sequence[str], share: float = 0.05, fit: Callable[[DataFrame], object] | None = None) -> tuple[object, DataFrame, DataFrame]:
    """The model fitted on rows at each path's lowest detectable rate, the chosen (path, rate), and those rows.

    rows: (rate, win, path, label, is_test, metrics), path null where label is 0. Every rate has a model of its own first,
    whose test scores tell which paths it detects.
    """
    fit = fit or (lambda f: Lasso.fit(f, metrics))
    rows = cut(rows)
    parts = []
    for (rate,) in rows.select("rate").distinct().orderBy("rate").collect():  # a handful of rates
        own = rows.filter(F.col("rate") == rate)
        parts.append(fit(own.filter("is_test = 0")).scored(own.filter("is_test = 1")).select("rate", "path", "label", "score"))
    chosen = cut(lowest_rates(detected(cut(reduce(DataFrame.unionByName, parts)), share)))
    merged = cut(lowered(rows, chosen))
    return fit(merged.filter("is_test = 0")), chosen, merged

"""Scores to decisions: ROC points, thresholds, confusion matrices by path, alert bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import first_overlap
from ..operators.lineage import cut
from ..operators.ranks import running


def _points(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, thr, y, z, tp, fp, p, n): rows of label 1 and 0 at each distinct score, and from the greatest score down to it."""
    g = cut(scores.groupBy(*keys, F.col("score").alias("thr")).agg(F.sum("label").alias("y"), (F.count("*") - F.sum("label")).alias("z")))
    total = g.groupBy(*keys).agg(F.sum("y").alias("p"), F.sum("z").alias("n"))
    down = running(g, "thr", ["y", "z"], keys, descending=True, written=True).withColumnsRenamed({"run_y": "tp", "run_z": "fp"})
    return down.join(total, list(keys)) if keys else down.crossJoin(total)


def roc_points(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(thr, tp, fp, p, n) at each distinct score, descending; scores are (score, label).

    Scores are first counted by value, so ties are one point; running totals go by ranges of scores.
    """
    return _points(scores, keys).drop("y", "z")


def corner_points(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC points without those on a straight line between their neighbours."""
    w = Window.partitionBy(*keys).orderBy(F.desc("thr"))
    step = lambda c: (F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c))
    (t1, t2), (f1, f2) = step("tp"), step("fp")
    return points.withColumn("_flat", F.coalesce((t1 == t2) & (f1 == f2), F.lit(False))).filter("not _flat").drop("_flat")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double"))


def best_f1(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(thr, f1) of the best threshold for score > thr: a tie group at the threshold is negative; the first best, descending."""
    before = _points(scores, keys).withColumns({"tp": F.col("tp") - F.col("y"), "fp": F.col("fp") - F.col("z")})
    at = before.withColumn("f1", F.coalesce(f1(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")), F.lit(0.0)))
    best = F.max(F.struct("f1", "thr")).alias("m")
    out = at.groupBy(*keys).agg(best) if keys else at.agg(best)
    return out.select(*keys, F.col("m.thr").alias("thr"), F.col("m.f1").alias("f1"))


def thresholded(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """pred = score > thr, with thresholds of (*keys, thr): one row for each key."""
    t = thresholds.select(*keys, "thr")
    joined = scores.join(t, list(keys)) if keys else scores.crossJoin(t)
    return joined.withColumn("pred", (F.col("score") > F.col("thr")).cast("int")).drop("thr")


def confusion(preds: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """tn, fp, fn, tp by path; a null path is 'No Attack'."""
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p))
    named = preds.withColumn("path", F.coalesce(F.col("path").cast("string"), F.lit("No Attack"))) if "path" in keys else preds
    return named.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def rates(cm: DataFrame) -> DataFrame:
    """F1, TPR, FPR of confusion rows; null for empty denominators."""
    c = F.col
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return cm.withColumns({"f1": f1(c("tp"), c("fp"), c("fn")), "tpr": div(c("tp"), c("tp") + c("fn")), "fpr": div(c("fp"), c("fp") + c("tn"))})


def rolled_up(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]
    return rates(cm.groupBy(*keys).agg(*sums) if keys else cm.agg(*sums))


def operating_points(points: DataFrame, share: float, keys: Sequence[str]) -> DataFrame:
    """The first point with the largest false positive rate of at most share, for each key."""
    ok = points.withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.col("n").cast("double"))).filter(F.col("fpr") <= share)
    first = F.max(F.struct(F.col("fp"), F.col("thr"), F.col("tp"), F.col("p"))).alias("m")
    return ok.groupBy(*keys).agg(first).select(*keys, F.col("m.thr").alias("thr"), F.try_divide(F.col("m.tp").cast("double"), F.col("m.p").cast("double")).alias("tpr"))


def lowest_rates(points: DataFrame) -> DataFrame:
    """The lowest rate of each path whose TPR is no worse than at the largest rate, and not 0; points are (path, rate, tpr)."""
    top = points.groupBy("path").agg(F.max_by("tpr", "rate").alias("top"), F.max("rate").alias("most"))
    ok = (F.col("tpr") >= F.col("top")) & (F.col("tpr") != 0) | (F.col("rate") == F.col("most"))
    return points.join(top, "path").filter(ok).groupBy("path").agg(F.min("rate").alias("rate"))


def alert_bins(alerts: DataFrame, bins: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of alerts (t) in equal bins between the first and the last one: (bin, lo, hi, alerts)."""
    span = alerts.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi")) if keys else alerts.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    n = span.withColumn("_n", bins)
    rows = alerts.join(n, list(keys)) if keys else alerts.crossJoin(n)
    width = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    at = F.least(F.floor(F.try_divide(F.col("t") - F.col("_lo"), width)), F.col("_n") - 1)
    return rows.groupBy(*keys, F.coalesce(at, F.lit(0)).cast("long").alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("alerts")).select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "alerts")


def path_times(rows: DataFrame, gran: int) -> DataFrame:
    """Seconds that each path was in use in each experiment: (exp, path, seconds)."""
    return rows.filter("path is not null").groupBy("exp", "path").agg((F.count("*") * gran).alias("seconds"))


def on_ensemble(frame: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata columns beside an ensemble's rows, by window and never by place."""
    return frame.join(meta, "win", "left")


def overlapping(bins: DataFrame, periods: DataFrame) -> DataFrame:
    """Each bin (lo, hi) with the first period (period_id, start, end) that it overlaps, null without; bins and periods are half open."""
    return first_overlap(bins, periods, "period_id")


def alert_confusion(bins: DataFrame, periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, tp, fp, fn, tn) of bins (lo, hi, alerts), against the periods that they overlap."""
    hit, alert = F.col("period_id").isNotNull(), F.col("alerts") > 0
    n = lambda c: F.count_if(c)
    counts = [n(alert & hit).alias("tp"), n(alert & ~hit).alias("fp"), n(~alert & hit).alias("fn"), n(~alert & ~hit).alias("tn")]
    rows = overlapping(bins, periods)
    return rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)

"""Operators over ordered windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import angle


def tumbling(rows: DataFrame, t: Column, grans: Sequence[int]) -> DataFrame:
    """Each row once for each granularity, with its window."""
    return rows.withColumn("gran", F.explode(F.array(*map(F.lit, grans)))).withColumn("win", F.floor(t / F.col("gran")))


def drop_last_window(rows: DataFrame, keys: Sequence[str] = ("gran",)) -> DataFrame:
    """Without each granularity's last window, which may be partial."""
    last = rows.groupBy(*keys).agg(F.max("win").alias("_last"))
    return rows.join(last, list(keys)).filter("win < _last").drop("_last")


def window_labels(spark, grans: Sequence[int], periods: DataFrame, length: int) -> DataFrame:
    """(gran, win, label): 1 where a period (start, end) covers the window, by integer division of both ends."""
    wins = spark.createDataFrame([(g,) for g in grans], "gran int").select("gran", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(length) / F.col("gran")) - 1)).alias("win"))
    # periods are opened into their windows, so the join is on equal ones
    p = periods.select(F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.array(*map(F.lit, grans))).alias("gran"))
    open_ = p.filter("_s div gran < _e div gran").select("gran", F.explode(F.expr("sequence(_s div gran, _e div gran - 1)")).alias("win"))
    hit = open_.distinct().withColumn("label", F.lit(1))
    return wins.join(hit, ["gran", "win"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def islands(labels: DataFrame, keys: Sequence[str] = ("gran",)) -> DataFrame:
    """Runs of label 1 as [win_start, win_end)."""
    one = labels.filter("label = 1").withColumn("_g", F.col("win") - F.row_number().over(Window.partitionBy(*keys).orderBy("win")))
    return one.groupBy(*keys, "_g").agg(F.min("win").alias("win_start"), (F.max("win") + 1).alias("win_end")).drop("_g")


def scheduled(wins: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each window with the first range (path_id, win_start, win_end) that covers it, null where none does.

    Ranges are opened into their windows, so the join is on equal windows.
    """
    open_ = schedule.filter("win_start < win_end").select("path_id", F.explode(F.sequence(F.col("win_start"), F.col("win_end") - 1)).alias("win"))
    return wins.join(open_.groupBy("win").agg(F.min("path_id").alias("path_id")), "win", "left")


def carried(rows: DataFrame, column: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def sliding_angles(vectors: DataFrame, size: int, keys: Sequence[str], order: str, column: str = "vector") -> DataFrame:
    """Angle of each vector to the mean of the size before it; null for the first ones and where a norm is 0.

    Vectors are filled up with zeros to the longest of their window and the current one, which leaves norms and
    products as they are; an empty vector counts as zeros only beside a non-empty one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-size, -1)
    rows = vectors.withColumn("_n", F.count("*").over(frame)).withColumn("_prev", F.collect_list(F.coalesce(column, F.array().cast("array<double>"))).over(frame))
    mean = F.aggregate("_prev", F.array().cast("array<double>"), lambda a, v: F.zip_with(a, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    rows = rows.withColumn("_m", F.transform(mean, lambda x: x / F.lit(float(size))))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("_m", column, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("angle", F.when(F.col("_n") == size, angle(dot, norm("_m"), norm(column)))).drop("_n", "_prev", "_m")


def rebucketed(scores: DataFrame, fine: int, coarse: int, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """The maximum over each coarse window of a fine series; for 0 / 1 alerts, their OR."""
    return scores.groupBy(*keys, F.floor(F.col("win") * fine / coarse).alias("win")).agg(F.max(column).alias(column))


def end_of_training(marked: DataFrame, gran: int) -> DataFrame:
    """The second at which the test part begins: its first window's start."""
    return marked.agg((F.min(F.when(F.col("is_test") == 1, F.col("win"))) * gran).alias("end"))


def past_training(win: Column, gran: int, end: int) -> Column:
    return win * gran > end


def test_mark(end_of_train: int, gran: int, largest: int) -> Column:
    return (F.col("win") >= (end_of_train // largest) * (largest // gran)).cast("int")

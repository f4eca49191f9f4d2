"""Live scoring: windows over a stream of flows, window features, sliding angles with kept state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import angles, in_order


def window_edges(flows: DataFrame, seconds: int, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Edges of tumbling windows; a window is complete, and so never partial, when the watermark has passed it."""
    w = F.window(time, f"{seconds} seconds")
    return flows.withWatermark(time, late).groupBy(w.alias("w"), "src", "dst").agg(F.sum("frames").alias("frames"), F.sum("weight").alias("weight")).select(F.col("w.start").alias("win"), "src", "dst", "frames", "weight")


def window_totals(flows: DataFrame, seconds: int, late: str = "1 minute", time: str = "ts", outside: str = "outside") -> DataFrame:
    out = F.when(F.col("dst") == outside, F.col("weight")).otherwise(0)
    w = F.window(time, f"{seconds} seconds")
    return flows.withWatermark(time, late).groupBy(w.alias("w")).agg(F.sum("weight").alias("weight"), F.sum(out).alias("out_weight"), F.approx_count_distinct("src").alias("sources")).select(F.col("w.start").alias("win"), "weight", "out_weight", "sources")


def sliding_angles(vectors: DataFrame, size: int, key: str = "key", order: str = "win", time: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, win, angle) of a stream of (key, win, vector, ts), to the mean of the size vectors before in order of time; state holds those and the rows that wait."""
    kind = dict(vectors.dtypes)
    return in_order(vectors, [key], time, angles([key], order, size), f"{key} {kind[key]}, {order} {kind[order]}, angle double", late)


def alert_table(scores: DataFrame, gran: int, threshold: float) -> DataFrame:
    """(time, alert) of scored windows (win, score): the second at which a window begins, and 1 where its score is over the threshold."""
    return scores.select((F.col("win") * gran).alias("time"), F.coalesce((F.col("score") > threshold).cast("int"), F.lit(0)).alias("alert"))


def score_each(features: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that scores each batch of complete windows and hands (win, score) to the sink."""
    return features.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(score(df), n)).start()

"""Packet-level operators: conversations from packets, slices and spans of a capture, transfer logs, result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def conversations(packets: DataFrame, keys: Sequence[str] = ("win",)) -> DataFrame:
    """Packets (keys, t, src, dst, bytes) by unordered address pair, with frames and bytes of both directions."""
    ab = F.when(F.col("src") <= F.col("dst"), 1).otherwise(0)
    rows = packets.withColumns({"addr_a": F.least("src", "dst"), "addr_b": F.greatest("src", "dst"), "_ab": ab})
    n = lambda c, v: F.sum(F.when(F.col("_ab") == c, v).otherwise(0))
    return rows.groupBy(*keys, "addr_a", "addr_b").agg(n(0, F.lit(1)).alias("frames_ba"), n(0, F.col("bytes")).alias("bytes_ba"), n(1, F.lit(1)).alias("frames_ab"), n(1, F.col("bytes")).alias("bytes_ab"), F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("duration"))


def first_part(packets: DataFrame, seconds: Column, window: int) -> DataFrame:
    """Packets before the end of the window that holds the given second."""
    return packets.filter(F.col("t") < F.ceil(seconds / window) * window)


def last_part(packets: DataFrame, share: float) -> DataFrame:
    """Packets of the last share of the capture's duration."""
    span = packets.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return packets.crossJoin(F.broadcast(span)).filter(F.col("t") > F.col("_lo") + (1 - share) * (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def span(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time and number of packets."""
    a = [F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("packets")]
    return packets.groupBy(*keys).agg(*a) if keys else packets.agg(*a)


def transfers(spark: SparkSession, path: str) -> DataFrame:
    """(bytes, first, last) over the received lines of a transfer log; times stand in brackets."""
    rows = spark.read.text(path).filter(F.col("value").contains("Received"))
    size = F.regexp_extract("value", r"Received\s*(\d+)\s*bytes", 1).try_cast("long")
    at = F.regexp_extract("value", r"\[([^\]]+)\]", 1)
    return rows.agg(F.sum(size).alias("bytes"), F.min(at).alias("first"), F.max(at).alias("last"))


def result_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result tables with the file each row is from."""
    return spark.read.option("header", True).option("inferSchema", True).csv(list(paths)).withColumn("file", F.col("_metadata.file_path"))

"""Views of star-schema and event tables in the engine's shapes: flows, nodes, events, scores, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(win, src, dst, frames, weight): line items as flows from supplier to customer nations in quarters; weight in cents."""
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").select("n_nationkey", "n_name")
    src = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey").select("l_suppkey", F.col("n_name").alias("src"))
    dst = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nations, "n_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("dst"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(dst, "o_custkey").select("l_orderkey", "dst")
    items = t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    win = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("long")
    return items.join(src, "l_suppkey").join(orders, "l_orderkey").select(win.alias("win"), "src", "dst", F.floor("l_quantity").cast("long").alias("frames"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("weight"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, svc, is_vip): nations in regions; the first nation of a region plays its VIP."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("node"), F.col("r_name").alias("svc"))
    first = rows.groupBy("svc").agg(F.min("node").alias("_v"))
    return rows.join(first, "svc").select("node", "svc", (F.col("node") == F.col("_v")).alias("is_vip"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, pod, svc, t, weight, value, kind): users as pods, seconds since the first of January, cents."""
    e = table(spark, sf_dir, "events")
    t = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))).cast("long")
    return e.select("event_id", F.col("user_id").alias("pod"), (F.col("user_id") % 6).alias("svc"), t.alias("t"), F.round(F.col("value") * 100).cast("long").alias("weight"), "value", F.col("event_type").alias("kind"))


def scores(spark: SparkSession, sf_dir: str, gran: int = 21600) -> DataFrame:
    """(event_id, win, path, score, label): values as scores of error events."""
    e = events(spark, sf_dir)
    return e.select("event_id", F.floor(F.col("t") / gran).alias("win"), (F.col("pod") % 4).alias("path"), F.col("value").alias("score"), (F.col("kind") == "error").cast("int").alias("label"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, since, status): orders as a change log of customers."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("since"), F.col("o_orderstatus").alias("status"))

"""Queries that run a stream over whole tables to its end, and their SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lineage import fresh
from .queries import query
from .streaming import identity, live


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern may stand for a single file too."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def to_end(found: DataFrame, store: str = identity.STORE) -> DataFrame:
    """What a stream gives until its sources have no more, as a table."""
    spark = found.sparkSession
    out = fresh(spark, "stream")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", store):
        found.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


@query("""WITH v AS (SELECT o_custkey AS key, o_orderdate AS since, max(o_orderstatus) AS status FROM orders GROUP BY ALL), q AS (SELECT o_orderkey, o_custkey AS key, o_orderdate + INTERVAL 30 DAY AS at FROM orders),
mark AS (SELECT max(o_orderdate) - INTERVAL 10 DAY AS mark FROM orders)
SELECT o_orderkey, q.key AS key, status FROM q ASOF LEFT JOIN v ON q.key = v.key AND q.at > v.since WHERE q.at <= (SELECT mark FROM mark)""")
def asof_stream(spark, d):
    """Orders a month later, named by the stream of their customer's orders, as far as the watermark comes."""
    orders = stream(spark, d, "orders")
    versions = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("since"), F.col("o_orderstatus").alias("status"))
    probes = orders.select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("at"))
    return to_end(identity.as_of(probes, versions, "key", "at", "since", ["status"], "10 days")).select("o_orderkey", "key", "status")


@query("""SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS time, CAST(max(value) > 99 AS INTEGER) AS alert FROM events GROUP BY ALL
HAVING (floor(epoch(min(ts)) / 21600) + 1) * 21600 <= (SELECT epoch(max(ts) - INTERVAL 1 HOUR) FROM events)""")
def alert_stream(spark, d):
    """Alerts of the complete windows of a stream of events."""
    e = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", "1 hour")
    scores = e.groupBy(F.window("ts", "21600 seconds").alias("w")).agg(F.max("value").alias("score"))
    wins = scores.select(F.floor(F.unix_timestamp("w.start") / 21600).alias("win"), "score")
    return to_end(live.alert_table(wins, 21600, 99.0))

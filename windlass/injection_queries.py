"""Queries of amounts that are carried on, drawn and injected, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import paths as P
from .operators import scan
from .operators.lineage import fresh
from .queries import EVENTS, FLOWS, _edges, query
from .sources import adapters as A
from .sources import capture
from .sources import packets as T
from .stream_queries import stream, to_end
from .streaming import ordered

_NUMBER = "list_reduce([0::BIGINT] || list_transform(range({at}, {at} + 8), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT), lambda c, y: c * 16 + y)"


def _normal(mean: str, deviation: float, h: str) -> str:
    """SQL of functions.exprs.normal; h is the hash's column."""
    u1, u2 = (f"((({_NUMBER.format(at=at)})::DOUBLE + 0.5) / 4294967296.0)".replace("substr(h,", f"substr({h},") for at in (1, 9))
    return f"({mean} + {deviation}::DOUBLE * sqrt(-2.0::DOUBLE * ln({u1})) * cos(2 * pi() * {u2}))"


def _carried(rates: str, seconds: int) -> str:
    """SQL of operators.scan.carried over (key, win, rate)."""
    step = lambda carry: f"CAST(floor((greatest(rate, 0) + {carry}) * {seconds} / 60) AS BIGINT)"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY win) AS k FROM {rates}),
c AS (SELECT key, win, k, {step('0')} AS amount FROM o WHERE k = 1 UNION ALL
  SELECT o.key, o.win, o.k, {step('CASE WHEN c.amount < 60 THEN c.amount ELSE 0 END')} FROM c JOIN o ON o.key = c.key AND o.k = c.k + 1)"""


_DAYS = "r AS (SELECT l_suppkey % 25 AS key, CAST(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS BIGINT) AS win, CAST(sum(floor(l_quantity)) % 97 AS DOUBLE) AS rate FROM lineitem GROUP BY ALL)"


def _days(spark, d):
    """(path, win, rate): shipped quantities by day and group of suppliers, as rates."""
    win = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return A.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("path"), win.alias("win")).agg((F.sum(F.floor("l_quantity")) % 97).cast("double").alias("rate"))


@query(f"WITH RECURSIVE {_DAYS}, {_carried('r', 30)} SELECT key AS path, win, amount, CASE WHEN amount >= 60 THEN amount ELSE 0 END AS sent FROM c")
def carried_amounts(spark, d):
    return scan.carried(_days(spark, d), ["path"], "win", "rate", 30)


@query(f"""WITH RECURSIVE {_DAYS}, x AS (SELECT key, win, rate, sha256('7:' || key || ':' || win) AS h FROM r), z AS (SELECT key, win, {_normal('rate', 20, 'h')} AS rate FROM x), {_carried('z', 30)}
SELECT key AS path, win, amount, CASE WHEN amount >= 60 THEN amount ELSE 0 END AS sent FROM c""")
def drawn_amounts(spark, d):
    rows = _days(spark, d).withColumn("rate", X.normal(F.col("rate"), 20.0, F.lit(7), F.col("path"), F.col("win")))
    return scan.carried(rows, ["path"], "win", "rate", 30)


@query(f"""WITH RECURSIVE {FLOWS}, r AS (SELECT src AS key, win, CAST(sum(weight) % 997 AS DOUBLE) AS rate, sha256('3:' || src || ':' || win) AS h, sha256('4:' || src || ':' || win) AS g FROM e GROUP BY ALL),
z AS (SELECT key, win, {_normal('rate', 100, 'h')} AS rate FROM r), {_carried('z', 6)},
p AS (SELECT c.key, c.win, amount, CAST(floor(amount / greatest({_normal('500.0::DOUBLE', 100, 'g')}, 1.0)) AS BIGINT) AS n FROM c JOIN r ON r.key = c.key AND r.win = c.win WHERE amount >= 60),
u AS (SELECT * FROM e UNION ALL SELECT win, key, 'internet', n, amount FROM p UNION ALL SELECT win, 'internet', key, n, n * 40 FROM p)
SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY ALL""")
def drawn_injection(spark, d):
    """Every node sends to the outside: amounts and packet sizes are drawn, too small amounts wait for the next window."""
    e = _edges(spark, d)
    rates = e.groupBy("src", "win").agg((F.sum("weight") % 997).cast("double").alias("rate"))
    drawn = rates.withColumn("rate", X.normal(F.col("rate"), 100.0, F.lit(3), F.col("src"), F.col("win")))
    sent = scan.carried(drawn, ["src"], "win", "rate", 6).filter("sent > 0")
    size = F.greatest(X.normal(F.lit(500.0), 100.0, F.lit(4), F.col("src"), F.col("win")), F.lit(1.0))
    hops = sent.select("win", "src", F.lit("internet").alias("dst"), F.col("sent").alias("bytes"), size.alias("size"))
    return P.inject(e, hops, packet=F.col("size"))


@query("""WITH RECURSIVE r AS (SELECT user_id % 6 AS key, event_id AS win, value::DOUBLE AS rate, ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, win) AS k FROM r),
c AS (SELECT key, win, k, ts, CAST(floor((greatest(rate, 0) + 0) * 10 / 60) AS BIGINT) AS amount FROM o WHERE k = 1 UNION ALL
  SELECT o.key, o.win, o.k, o.ts, CAST(floor((greatest(rate, 0) + CASE WHEN c.amount < 60 THEN c.amount ELSE 0 END) * 10 / 60) AS BIGINT) FROM c JOIN o ON o.key = c.key AND o.k = c.k + 1)
SELECT key AS path, win, amount, CASE WHEN amount >= 60 THEN amount ELSE 0 END AS sent FROM c WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def carry_stream(spark, d):
    """The carry as kept state of a stream of events, as far as the watermark comes."""
    e = stream(spark, d, "events").select((F.col("user_id") % 6).alias("path"), F.col("event_id").alias("win"), F.col("value").cast("double").alias("rate"), F.col("ts").cast("timestamp").alias("ts"))
    return to_end(ordered.in_order(e, ["path"], "ts", ordered.carrying(["path"], "win", "rate", 10), "path long, win long, amount long, sent long", "1 hour", "win"))


_PACKETS = f"""{EVENTS}, pk AS (SELECT event_id, pod, svc, CAST(epoch_us(ts) AS BIGINT) AS t, greatest(weight, 34) AS bytes FROM ev JOIN events USING (event_id)),
ad AS (SELECT t, '10.0.' || ((pod // 256) % 256) || '.' || (pod % 256) AS src, '10.1.0.' || svc AS dst, bytes FROM pk UNION ALL SELECT t, '10.1.0.' || svc, '10.0.' || ((pod // 256) % 256) || '.' || (pod % 256), 60 FROM pk WHERE event_id % 3 = 0)"""


@query(f"""WITH {_PACKETS}, x AS (SELECT CAST(t // 21600000000 AS BIGINT) AS win, least(src, dst) AS addr_a, greatest(src, dst) AS addr_b, src <= dst AS ab, bytes FROM ad)
SELECT win, addr_a, addr_b, count(*) FILTER (NOT ab) AS frames_ba, CAST(coalesce(sum(bytes) FILTER (NOT ab), 0) AS BIGINT) AS bytes_ba, count(*) FILTER (ab) AS frames_ab, CAST(coalesce(sum(bytes) FILTER (ab), 0) AS BIGINT) AS bytes_ab FROM x GROUP BY ALL""")
def capture_conversations(spark, d):
    """Events as packets, written as capture files and read back in splits: conversations of windows."""
    e = A.events(spark, d).join(A.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "event_id")
    pod = F.concat_ws(".", F.lit("10.0"), ((F.col("pod") / 256).cast("long") % 256).cast("string"), (F.col("pod") % 256).cast("string"))
    svc = F.concat(F.lit("10.1.0."), F.col("svc").cast("string"))
    there = e.select(F.col("us").alias("t"), pod.alias("src"), svc.alias("dst"), F.greatest("weight", F.lit(34)).alias("bytes"))
    back = e.filter("event_id % 3 = 0").select(F.col("us").alias("t"), svc.alias("src"), pod.alias("dst"), F.lit(60).cast("long").alias("bytes"))
    capture.register(spark)
    path = fresh(spark, "capture")
    there.union(back).write.format("capture").mode("append").save(path)
    packets = spark.read.format("capture").option("split", 1 << 18).load(path).withColumn("win", F.floor(F.col("t") / 21_600_000_000))
    return T.conversations(packets).drop("start", "duration")

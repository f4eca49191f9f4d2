import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from windlass.operators.scan import carried
from windlass.stream_queries import setting
from windlass.streaming import identity, live, ordered


def test_windows_are_complete(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=5 * i), "a", "b" if i % 2 else "outside", 1, 10) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, src string, dst string, frames long, weight long").coalesce(1).write.parquet(str(tmp_path / "in"))
    flows = spark.readStream.schema("ts timestamp, src string, dst string, frames long, weight long").parquet(str(tmp_path / "in"))
    live.window_edges(flows, 60, "0 seconds").writeStream.format("memory").queryName("edges").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    got = spark.table("edges").groupBy("win").agg(F.sum("weight").alias("w")).orderBy("win").collect()
    assert [r.w for r in got] == [120, 120, 120]  # the last window, not yet passed, is not there


def _files(spark, path, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, out, name):
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", identity.STORE):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def _at(i):
    return datetime(2024, 1, 1) + timedelta(seconds=i)


def test_angles_keep_state_and_order(spark, tmp_path):
    """Rows out of order, within a batch and between two."""
    rows = [("k", i, v, _at(i)) for i, v in enumerate([[1.0, 1.0], [4.0, 2.0], [2.0, 4.0], [1000.0, 1000.0]])]
    stream = _files(spark, str(tmp_path), "key string, win long, vector array<double>, ts timestamp", [rows[2], rows[0]], [rows[3], rows[1]], [("far", 0, [1.0], _at(10**6))])
    got = [r.angle for r in _run(spark, live.sliding_angles(stream, 2, late="10 seconds"), "angles").filter("key = 'k'").orderBy("win").collect()]
    assert got[:2] == [None, None] and abs(got[2] - 0.5667292) < 1e-6 and abs(got[3]) < 1e-6


def test_carry_over_batches_equals_the_scan(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, w, rng.choice([None, -3.0, 10.0, 25.5, 70.0, 200.0]), _at(10 * w)) for k in ("a", None) for w in range(60)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 8)
    schema = "path string, win long, rate double, ts timestamp"
    stream = _files(spark, str(tmp_path), schema, mixed[:50], mixed[50:90], mixed[90:], [("far", 0, 1.0, _at(10**6))])
    found = ordered.in_order(stream, ["path"], "ts", ordered.carrying(["path"], "win", "rate", 30), "path string, win long, amount long, sent long", "200 seconds")
    got = _run(spark, found, "amounts").filter("path = 'a' or path is null")
    want = carried(spark.createDataFrame(rows, schema), ["path"], "win", "rate", 30)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.filter("sent > 0").count() > 10


def test_last_known_names(spark, tmp_path):
    rows = [("s", w, name, _at(w)) for w, name in enumerate([None, "dns-1", None, None, "dns-2", None])]
    stream = _files(spark, str(tmp_path), "svc string, win long, dns string, ts timestamp", [rows[i] for i in (2, 0, 1)], [rows[i] for i in (5, 3, 4)], [("far", 0, "x", _at(10**6))])
    found = ordered.in_order(stream, ["svc"], "ts", ordered.last_known(["svc"], "win", "dns"), "svc string, win long, dns string", "10 seconds")
    assert [r.dns for r in _run(spark, found, "names").filter("svc = 's'").orderBy("win").collect()] == [None, "dns-1", "dns-1", "dns-1", "dns-2", "dns-2"]


def test_score_each(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "win long, x double").write.parquet(str(tmp_path / "in"))
    seen = []
    q = live.score_each(spark.readStream.schema("win long, x double").parquet(str(tmp_path / "in")), lambda df: df.withColumn("score", F.col("x") * 2), lambda df, n: seen.extend(r.score for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [4.0]


def test_rows_of_one_time_come_in_the_order_of_their_numbers(spark, tmp_path):
    """10 after 9, and negative numbers first, as SQL's order has them."""
    wins = [10, -2, 9, 100, -10, 2**40]
    stream = _files(spark, str(tmp_path), "key string, win long, ts timestamp", [("k", w, _at(0)) for w in wins], [("far", 0, _at(10**6))])
    count = lambda state, rows: ((state or 0) + len(rows), [{"win": r["win"], "n": (state or 0) + i} for i, r in enumerate(rows)])
    found = ordered.in_order(stream, ["key"], "ts", count, "win long, n long", "10 seconds", tie="win")
    assert [r.win for r in _run(spark, found, "ties").orderBy("n").collect()] == sorted(wins)

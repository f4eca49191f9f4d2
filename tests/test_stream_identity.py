import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windlass.operators.identity import as_of
from windlass.sources import adapters
from windlass.streaming import identity

from .oracle import DATA

FAR = datetime(2200, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", identity.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _replay(spark, path, probes, versions, schemas, late, salts, batches, name, seed=1):
    """Both lists dealt over files that a stream reads one at a time, then far rows that push the watermark past all."""
    rng = random.Random(seed)
    for kind, rows in (("p", probes), ("v", versions)):
        rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or FAR))
        step = -(-len(rows) // batches)
        shift = rows[:]
        # neighbours change places, over the borders of the batches too
        for i in range(0, len(shift) - step, step // 2 or 1):
            part = shift[i:i + step]
            rng.shuffle(part)
            shift[i:i + step] = part
        for k in range(batches):
            if part := shift[k * step:(k + 1) * step]:
                spark.createDataFrame(part, schemas[kind]).coalesce(1).write.mode("append").parquet(f"{path}/{kind}")
        for k in range(2):
            spark.createDataFrame([(-1, FAR + timedelta(days=k), *["far"] * (len(rows[0]) - 2))], schemas[kind]).coalesce(1).write.mode("append").parquet(f"{path}/{kind}")
    stream = {k: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{path}/{k}") for k, s in schemas.items()}
    found = identity.as_of(stream["p"], stream["v"], "key", "at", "since", ["status"], late, salts)
    found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination(240)
    return spark.table(name).filter("key <> -1 or key is null")


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("salts", [1, 3])
def test_names_flows_as_the_batch_does(spark, tmp_path, salts):
    start, rng = datetime(2024, 1, 1), random.Random(salts)
    at = lambda: start + timedelta(milliseconds=rng.randrange(0, 200_000, 50), microseconds=rng.randrange(3))
    probes = [(rng.choice([1, 1, 1, 1, 2, 3, None]), at(), f"flow {i}\n\"x\"") for i in range(240)] + [(1, None, "no time")]
    versions = [(rng.choice([1, 2, 4, None]), at(), rng.choice(["a", "b", None, "line\nbreak"])) for _ in range(60)]
    versions += [(1, versions[0][1], "z"), (1, versions[0][1], "y"), (2, probes[4][1], "same time")]
    schemas = {"p": "key int, at timestamp, flow string", "v": "key int, since timestamp, status string"}
    got = _replay(spark, str(tmp_path), probes, versions, schemas, "300 seconds", salts, 4, f"asof{salts}")
    want = as_of(spark.createDataFrame(probes, schemas["p"]), spark.createDataFrame(versions, schemas["v"]), "key", "at", "since", ["status"])
    assert _rows(got) == _rows(want)


def test_replays_the_orders_log(spark, tmp_path):
    """A sixth of the customers' orders as change log, and as flows a month later, in shuffled batches."""
    log = adapters.order_log(spark, f"{DATA}/sf0.001").select(F.col("key").cast("int").alias("key"), F.col("since").cast("timestamp").alias("since"), "status")
    probes = log.select("key", (F.col("since") + F.expr("interval 30 days")).alias("at"), F.concat_ws("-", "status", F.lit("order")).alias("flow")).filter("key % 6 = 1")
    versions = log.filter("key % 6 = 1")
    schemas = {"p": "key int, at timestamp, flow string", "v": "key int, since timestamp, status string"}
    got = _replay(spark, str(tmp_path), [tuple(r) for r in probes.collect()], [tuple(r) for r in versions.collect()], schemas, "5000 days", 1, 3, "asof_log")
    assert probes.count() > 100 and _rows(got) == _rows(as_of(probes, versions, "key", "at", "since", ["status"]))


def test_answers_come_before_the_end_and_old_versions_go(spark, tmp_path):
    """With a short delay the first flows are answered while the stream runs, by the versions of their time."""
    start = datetime(2024, 1, 1)
    versions = [(1, start + timedelta(seconds=10 * i), f"v{i}") for i in range(40)]
    probes = [(1, start + timedelta(seconds=10 * i + 5), f"f{i}") for i in range(40)]
    schemas = {"p": "key int, at timestamp, flow string", "v": "key int, since timestamp, status string"}
    for kind, rows in (("p", probes), ("v", versions)):
        for k in range(4):
            spark.createDataFrame(rows[10 * k:10 * k + 10], schemas[kind]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}")
    stream = {k: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{k}") for k, s in schemas.items()}
    found = identity.as_of(stream["p"], stream["v"], "key", "at", "since", ["status"], "20 seconds")
    q = found.writeStream.format("memory").queryName("asof_live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.flow: r.status for r in spark.table("asof_live").collect()}
    # the watermark comes to 390 s less 20 s
    assert got == {f"f{i}": f"v{i}" for i in range(37)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept and kept[-1] < 40

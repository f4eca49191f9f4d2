"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Scratch:
    """Written tables that cut lineage; they lie in the shared folder, so a lost executor loses none."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of jobs whose frames are gone; it waits for a collection otherwise."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = 64, chars: int = 1 << 20, column: str = "text"):
    """Arrow batches cut into pieces of bounded rows and text, so that a task's memory doesn't depend on the batch size."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            if i > at and (i - at >= rows or total + sizes[i] > chars):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += sizes[i]
        yield batch.slice(at, n - at)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SMALL_GRAPH = 250_000


def _joined_up(batches):
    """Components of the one task's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = sorted(parent)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "component_id"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components by alternating large-star and small-star steps; edges (a, b) of longs, result (id, component_id).

    component_id is the smallest id reachable. Ids without an edge are not in the result. Each round halves the
    height of the trees, and map-side minima keep a hub from gathering in one task. Graphs of at most SMALL_GRAPH edges
    (4 MB) are joined up in one task instead, which saves the rounds.
    """
    both = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = scratch.table(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    sign = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    k, before, now = 0, None, sign(e)
    if now[0] <= small:
        return e.select("a", "b").coalesce(1).mapInArrow(_joined_up, "id long, component_id long")
    while now != before:
        k, before = k + 1, now
        sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low-{k}")
        # large star: each larger neighbour goes to the smallest of the neighbourhood
        large = sides.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(large.distinct(), f"{name}-large-{k}")
        # small star: smaller neighbours and the vertex itself go to the smallest one
        down = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down-{k}")
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = scratch.table(down.select("a", F.col("m").alias("b")).union(small).distinct(), f"{name}-{k}")
        now = sign(nxt)
        scratch.drop(f"{name}-low-{k}", f"{name}-large-{k}", f"{name}-down-{k}", f"{name}-{k - 1}")
        e = nxt
    stars = e.groupBy("a").agg(F.min("b").alias("component_id"))
    roots = e.select(F.col("b").alias("id")).distinct().join(stars.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component_id"))
    return stars.select(F.col("a").alias("id"), "component_id").union(roots)

"""Shortest-path centralities of all graphs at once, as joins and grouped sums: no task has a whole graph.

Distances (1 / weight) grow from every node in rounds: what a round has made shorter goes along all edges in the next one.
From them come the pairs (before, node) of all shortest ways of a source. Counts of ways go forwards along these, what passes
a node goes back; both are sums over rounds, as many as the longest shortest way has hops. With n nodes a graph has up to n^2
distances by definition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import KEYS, nodes_of
from .lineage import cut

#: Ways whose lengths differ by less than this part are equally long.
EQUAL = 1e-12


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EQUAL * F.greatest(F.lit(1.0), b)


def lengths(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, u, v, length) of edges with weight, parallel ones added up; loops go."""
    e = edges.filter("src <> dst and weight > 0").groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("w"))
    return e.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"), (1.0 / F.col("w")).alias("length"))


def distances(e: DataFrame, keys: Sequence[str] = KEYS, sources: Sequence[str] | None = None) -> DataFrame:
    """(*keys, s, t, d): the least length from each source (all nodes, if none are listed) to each other node that it reaches."""
    first = e if sources is None else e.filter(F.col("u").isin(*sources))
    known = front = cut(first.select(*keys, F.col("u").alias("s"), F.col("v").alias("t"), F.col("length").alias("d")))
    while True:
        step = front.join(e.withColumnRenamed("u", "t"), [*keys, "t"]).filter("v <> s").groupBy(*keys, "s", F.col("v").alias("t")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        both = step.join(known, [*keys, "s", "t"], "left")
        shorter = F.col("d").isNull() | ((F.col("new") < F.col("d")) & ~_near(F.col("new"), F.col("d")))
        front = cut(both.filter(shorter).select(*keys, "s", "t", F.col("new").alias("d")))
        if not front.limit(1).count():
            return known
        known = cut(known.join(front.select(*keys, "s", "t"), [*keys, "s", "t"], "left_anti").unionByName(front))


def ways(e: DataFrame, d: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, s, v, w): the edges v -> w that shortest ways from s take."""
    start = d.select(*keys, "s").distinct().select(*keys, "s", F.col("s").alias("v"), F.lit(0.0).alias("dv"))
    to = start.unionByName(d.select(*keys, "s", F.col("t").alias("v"), F.col("d").alias("dv")))
    over = to.join(e.withColumnRenamed("v", "w").withColumnRenamed("u", "v"), [*keys, "v"])
    return over.join(d.select(*keys, "s", F.col("t").alias("w"), "d"), [*keys, "s", "w"]).filter(_near(F.col("dv") + F.col("length"), F.col("d"))).select(*keys, "s", "v", "w")


def _rounds(x: DataFrame, step) -> DataFrame:
    """x and all that steps make of it, until one makes nothing."""
    parts = [cut(x)]
    while parts[-1].limit(1).count():
        parts.append(cut(step(parts[-1])))
    return reduce(DataFrame.unionByName, parts)


def _passed(back: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, s, node, x): what passes each node on its way back to s, from held (*keys, s, w, x) along back (*keys, s, v, w, part)."""
    def step(h: DataFrame) -> DataFrame:
        moved = h.join(back, [*keys, "s", "w"]).filter("v <> s")
        return moved.groupBy(*keys, "s", F.col("v").alias("w")).agg(F.sum(F.col("x") * F.col("part")).alias("x"))

    first = cut(step(held))
    return _rounds(first, step).groupBy(*keys, "s", F.col("w").alias("node")).agg(F.sum("x").alias("x"))


def centralities(edges: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS, sources: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """(*keys, node, metric, value) for every node of every graph.

    betweenness: shares of shortest ways through a node, ends included, by all ordered pairs; betweenness_subset: of ways from
    sources to targets only, without their ends; load: what passes a node when each node sends one to each other, split evenly at each
    branch on the way back; harmonic: the sum of inverse distances to a node.
    """
    keys = list(keys)
    nodes = cut(nodes_of(edges, keys))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    e = cut(lengths(edges, keys))
    d = distances(e, keys, sources if set(metrics) == {"betweenness_subset"} else None)
    found = []
    if "harmonic" in metrics:
        found.append(d.groupBy(*keys, F.col("t").alias("node")).agg(F.sum(1 / F.col("d")).alias("x")).withColumn("metric", F.lit("harmonic")))
    if set(metrics) - {"harmonic"}:
        p = cut(ways(e, d, keys))
        one = d.select(*keys, "s", F.col("t").alias("w"), F.lit(1.0).alias("x"))
        if {"betweenness", "betweenness_subset"} & set(metrics):
            start = d.select(*keys, "s").distinct().select(*keys, "s", F.col("s").alias("w"), F.lit(1.0).alias("c"))
            forth = lambda c: c.withColumnRenamed("w", "v").join(p, [*keys, "s", "v"]).groupBy(*keys, "s", "w").agg(F.sum("c").alias("c"))
            count = cut(_rounds(start, forth).groupBy(*keys, "s", "w").agg(F.sum("c").alias("c")))
            share = p.join(count, [*keys, "s", "w"]).join(count.select(*keys, "s", F.col("w").alias("v"), F.col("c").alias("cv")), [*keys, "s", "v"])
            share = cut(share.select(*keys, "s", "v", "w", (F.col("cv") / F.col("c")).alias("part")))
            if "betweenness" in metrics:
                # a way's ends: once for each pair at its source, once at its goal
                ends = d.select(*keys, F.col("s").alias("node"), F.lit(1.0).alias("x")).unionByName(d.select(*keys, F.col("t").alias("node"), F.lit(1.0).alias("x")))
                rows = ends.unionByName(_passed(share, one, keys).select(*keys, "node", "x"))
                found.append(rows.groupBy(*keys, "node").agg(F.sum("x").alias("x")).withColumn("metric", F.lit("betweenness")))
            if "betweenness_subset" in metrics:
                some = _passed(share.filter(F.col("s").isin(*sources)), one.filter(F.col("s").isin(*sources) & F.col("w").isin(*targets)), keys)
                found.append(some.groupBy(*keys, "node").agg(F.sum("x").alias("x")).withColumn("metric", F.lit("betweenness_subset")))
        if "load" in metrics:
            many = p.groupBy(*keys, "s", "w").agg((1.0 / F.count("*")).alias("part"))
            back = cut(p.join(many, [*keys, "s", "w"]))
            found.append(_passed(back, one, keys).groupBy(*keys, "node").agg(F.sum("x").alias("x")).withColumn("metric", F.lit("load")))
    values = reduce(DataFrame.unionByName, found)
    every = nodes.join(n, keys).withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    inner = (F.col("n") - 1) * (F.col("n") - 2)
    pairs = F.when(F.col("metric") == "harmonic", F.lit(1)).when(F.col("metric") == "betweenness", F.col("n") * (F.col("n") - 1)).otherwise(inner)
    value = F.coalesce("x", F.lit(0.0)) / F.when(pairs > 0, pairs).otherwise(1)
    return every.join(values, [*keys, "node", "metric"], "left").select(*keys, "node", "metric", value.alias("value"))

"""Extremely randomised trees (Geurts et al. 2006), grown level by level over all rows.

A level takes two passes. The first finds each open node's range of every metric and its class counts; then some metrics are
drawn for a node and a threshold at random within each one's range. The second counts the classes on both sides of all
drawn splits, by tasks and then by one grouped sum, and the split of least impurity is kept. Rows find their nodes by
walking down the trees, so nothing but the trees is kept between passes; they have at most 2^depth leaves. A node's draws
depend on the seed, its tree and its place alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

Split = tuple[int, float]


def walk(tree: dict[int, Split], x: np.ndarray) -> np.ndarray:
    """The node of each row: the root is 1, the children of k are 2 k and 2 k + 1; up to the threshold rows go left."""
    node = np.ones(len(x), np.int64)
    for k in sorted(tree):  # parents come before children
        here = node == k
        metric, cut_ = tree[k]
        node[here] = 2 * k + (x[here, metric] > cut_)
    return node


def draw(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, tries: int) -> list[Split]:
    """Splits of a node: metrics at random among those that vary in it, a threshold within each one's range."""
    r = np.random.default_rng((seed, tree, node))
    varied = np.flatnonzero(high > low)
    return [(int(m), float(low[m] + (high[m] - low[m]) * r.random())) for m in r.permutation(varied)[:tries]]


def impurity(counts: np.ndarray) -> float:
    """Gini impurity of both sides, by their rows; counts: side x class."""
    n = counts.sum(1)
    return float(sum(k * (1 - ((c / k) ** 2).sum()) for c, k in zip(counts, n) if k) / n.sum())


def best(splits: list[Split], counts: np.ndarray) -> Split | None:
    """The first split of least impurity; None where none has rows on both sides."""
    ranked = [(impurity(c), k) for k, c in enumerate(counts) if c.sum(1).min() > 0]
    return splits[min(ranked)[1]] if ranked else None


def _matrix(batch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _ranges(trees, open_):
    """(tree, node, metric, low, high, n0, n1) of a task's rows."""
    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch), batch.column(1).to_numpy(zero_copy_only=False)
            for t, tree in enumerate(trees.value):
                node = walk(tree, x)
                for k in np.unique(node):
                    if (t, int(k)) in open_.value:
                        here = node == k
                        low, high, one = x[here].min(0), x[here].max(0), int((y[here] > 0.5).sum())
                        old = held.get((t, int(k)))
                        held[t, int(k)] = [low, high, int(here.sum()) - one, one] if old is None else [np.minimum(low, old[0]), np.maximum(high, old[1]), old[2] + int(here.sum()) - one, old[3] + one]
        for (t, k), (low, high, zero, one) in held.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, k)), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(n, zero)), pa.array(np.full(n, one))], names=["tree", "node", "metric", "low", "high", "n0", "n1"])

    return run


def _counts(trees, splits):
    """(tree, node, split, side, label, n) of a task's rows."""
    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch), (batch.column(1).to_numpy(zero_copy_only=False) > 0.5).astype(int)
            for t, tree in enumerate(trees.value):
                node = walk(tree, x)
                for k in np.unique(node):
                    tried = splits.value.get((t, int(k)))
                    if tried:
                        here = node == k
                        sides = np.stack([x[here, m] > c for m, c in tried]).astype(int)
                        found = np.stack([np.bincount(2 * s + y[here], minlength=4).reshape(2, 2) for s in sides])
                        held[t, int(k)] = held.get((t, int(k)), 0) + found
        for (t, k), found in held.items():
            i, side, label = (a.ravel().astype(np.int32) for a in np.indices(found.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, t, np.int32)), pa.array(np.full(found.size, k)), pa.array(i), pa.array(side), pa.array(label), pa.array(found.ravel().astype(np.int64))], names=["tree", "node", "split", "side", "label", "n"])

    return run


def _scorer(model):
    def run(batches):
        trees, leaves, overall = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            total = np.zeros(batch.num_rows)
            for t, tree in enumerate(trees):
                share = {k: v for (u, k), v in leaves.items() if u == t}
                total += np.array([share.get(k, overall) for k in walk(tree, x).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total / len(trees))], names=[*batch.schema.names[1:], "score"])

    return run


class ExtraTrees:
    """Trees over all rows, without a draw of rows; the score is the mean of the leaves' shares of class 1."""

    def __init__(self, trees: int = 10, depth: int = 8, tries: int | None = None, least: int = 2, seed: int = 0):
        """tries: drawn splits of a node, the square root of the metrics by default; least: rows of a node that is split."""
        self.n, self.depth, self.tries, self.least, self.seed = trees, depth, tries, least, seed

    def fit(self, frame: DataFrame, metrics: Sequence[str], label: str = "label") -> ExtraTrees:
        context = frame.sparkSession.sparkContext
        self.metrics = list(metrics)
        rows = cut(self._rows(frame).select("_x", F.col(label).cast("double").alias("y")))
        tries = self.tries or max(1, int(len(metrics) ** 0.5))
        self.trees: list[dict[int, Split]] = [{} for _ in range(self.n)]
        self.leaves: dict[tuple[int, int], float] = {}
        open_ = {(t, 1) for t in range(self.n)}
        self.overall = rows.agg(F.avg((F.col("y") > 0.5).cast("int"))).first()[0] or 0.0
        for level in range(self.depth + 1):
            trees = context.broadcast(self.trees)
            # as many rows as open nodes have metrics
            found = rows.mapInArrow(_ranges(trees, context.broadcast(open_)), "tree int, node long, metric int, low double, high double, n0 long, n1 long")
            nodes: dict[tuple[int, int], list] = {}
            for r in found.groupBy("tree", "node", "metric").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toLocalIterator():
                nodes.setdefault((r.tree, r.node), []).append((r.metric, r.low, r.high, r.n0, r.n1))
            splits = {}
            for at, parts in nodes.items():
                _, low, high, n0, n1 = zip(*sorted(parts))
                self.leaves[at] = n1[0] / (n0[0] + n1[0])
                if level < self.depth and n0[0] and n1[0] and n0[0] + n1[0] >= self.least:
                    splits[at] = draw(self.seed, *at, np.array(low), np.array(high), tries)
            if not any(splits.values()):
                break
            counted = rows.mapInArrow(_counts(trees, context.broadcast(splits)), "tree int, node long, split int, side int, label int, n long").groupBy("tree", "node", "split", "side", "label").agg(F.sum("n").alias("n"))
            tables = {at: np.zeros((len(s), 2, 2), np.int64) for at, s in splits.items()}
            for r in counted.toLocalIterator():
                tables[r.tree, r.node][r.split, r.side, r.label] = r.n
            open_ = set()
            for at, table in tables.items():
                if chosen := best(splits[at], table):
                    self.trees[at[0]][at[1]] = chosen
                    open_ |= {(at[0], 2 * at[1]), (at[0], 2 * at[1] + 1)}
                    del self.leaves[at]
            if not open_:
                break
        return self

    def _rows(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("_x", F.array(*(F.col(f"`{m}`").cast("double") for m in self.metrics)))

    def scored(self, frame: DataFrame) -> DataFrame:
        """frame with score."""
        model = frame.sparkSession.sparkContext.broadcast((self.trees, self.leaves, self.overall))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return self._rows(frame).select("_x", *(F.col(f"`{c}`") for c in frame.columns)).mapInArrow(_scorer(model), f"{schema}, score double")

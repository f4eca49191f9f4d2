"""Centralities that need linear algebra or shortest paths: numpy functions of one graph's edges.

A task gets one graph (of one window: tens to hundreds of nodes) and returns all requested metrics in long form, so
there is one shuffle for all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


class Graph:
    def __init__(self, src, dst, weight):
        self.names = sorted({*src, *dst})
        at = {n: i for i, n in enumerate(self.names)}
        n = self.n = len(self.names)
        self.w = np.zeros((n, n))
        for s, d, w in zip(src, dst, weight):
            if s != d and w > 0:
                self.w[at[s], at[d]] += w
        self.out = [np.flatnonzero(row).tolist() for row in self.w]

    def tree(self, s: int):
        """Dijkstra by 1 / weight: order of settling, predecessors, path counts and distances."""
        dist, sigma, pred, order, done = {s: 0.0}, {s: 1.0}, {s: []}, [], set()
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u in self.out[v]:
                e = d + 1 / self.w[v, u]
                if u not in dist or e < dist[u] - 1e-12 * max(1.0, dist[u]):
                    dist[u], sigma[u], pred[u] = e, sigma[v], [v]
                    heapq.heappush(heap, (e, u))
                elif abs(e - dist[u]) <= 1e-12 * max(1.0, dist[u]) and u not in done:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        return order, pred, sigma, dist


def betweenness(g: Graph, sources=None, targets=None, endpoints: bool = True) -> np.ndarray:
    """Shares of shortest paths through a node (Brandes 2001); with sources and targets, of theirs only."""
    b = np.zeros(g.n)
    for s in range(g.n) if sources is None else sources:
        order, pred, sigma, _ = g.tree(s)
        delta = dict.fromkeys(order, 0.0)
        if endpoints and targets is None:
            b[s] += len(order) - 1
        for v in reversed(order):
            own = 1.0 if targets is None or v in targets and v != s else 0.0
            for u in pred[v]:
                delta[u] += sigma[u] / sigma[v] * (own + delta[v])
            if v != s:
                b[v] += delta[v] + (1 if endpoints and targets is None else 0)
    pairs = g.n * (g.n - 1) if endpoints and targets is None else (g.n - 1) * (g.n - 2)
    return b / pairs if pairs > 0 else b


def load(g: Graph) -> np.ndarray:
    """Newman's load: a packet from each node to each, split evenly at each branch of the way back."""
    b = np.zeros(g.n)
    for s in range(g.n):
        order, pred, _, _ = g.tree(s)
        held = dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for u in pred[v]:
                if u != s:
                    held[u] += held[v] / len(pred[v])
        for v in order:
            if v != s:
                b[v] += held[v] - 1
    return b / ((g.n - 1) * (g.n - 2)) if g.n > 2 else b


def harmonic(g: Graph) -> np.ndarray:
    """Sum of inverse distances of all nodes to a node."""
    h = np.zeros(g.n)
    for s in range(g.n):
        for v, d in g.tree(s)[3].items():
            if d > 0:
                h[v] += 1 / d
    return h


def largest_component(g: Graph) -> list[int]:
    near, left, best = (g.w + g.w.T) > 0, set(range(g.n)), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v not in part:
                part.add(v)
                todo += [u for u in np.flatnonzero(near[v]).tolist() if u not in part]
        left -= part
        if len(part) > len(best):
            best = sorted(part)
    return best


def current_flow(g: Graph, sources=None, targets=None, normalised: bool = True) -> np.ndarray:
    """Current through each node of the largest undirected component, weights as conductance (Brandes & Fleischer 2005)."""
    part, out = largest_component(g), np.full(g.n, np.nan)
    n = len(part)
    if n < 2:
        return out
    c = (g.w + g.w.T)[np.ix_(part, part)]
    potential = np.linalg.pinv(np.diag(c.sum(1)) - c)
    at = {v: i for i, v in enumerate(part)}
    ss = range(n) if sources is None else [at[s] for s in sources if s in at]
    ts = range(n) if targets is None else [at[t] for t in targets if t in at]
    b = np.zeros(n)
    for s in ss:
        for t in ts:
            if s == t or (sources is None and t < s):
                continue
            p = potential[:, s] - potential[:, t]
            through = 0.5 * (c * np.abs(p[:, None] - p[None, :])).sum(1)
            through[[s, t]] = 0
            b += through
    if normalised and n > 2:
        b *= (2 if sources is None else 1) / ((n - 1) * (n - 2))
    out[part] = b
    return out


def principal_vector(g: Graph) -> np.ndarray:
    """Eigenvector of the eigenvalue of largest real part, its sum non-negative."""
    value, vector = np.linalg.eig(g.w)
    v = np.real(vector[:, int(np.argmax(value.real))])
    norm = np.linalg.norm(v)
    return (v if v.sum() >= 0 else -v) / (norm if norm else 1)


METRICS = {
    "betweenness": lambda g, s, t: betweenness(g), "load": lambda g, s, t: load(g), "harmonic": lambda g, s, t: harmonic(g), "current_flow": lambda g, s, t: current_flow(g),
    "betweenness_subset": lambda g, s, t: betweenness(g, s, t, False), "current_flow_subset": lambda g, s, t: current_flow(g, s, t), "current_flow_subset_raw": lambda g, s, t: current_flow(g, s, t, False), "eigenvector": lambda g, s, t: principal_vector(g),
}


def centralities(edges: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("win",), sources: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """(*keys, node, metric, value) of the requested metrics of each graph; null where one isn't defined."""
    types = dict(edges.dtypes)

    def run(key, pdf):
        g = Graph(pdf.src, pdf.dst, pdf.weight)
        s, t = ([i for i, n in enumerate(g.names) if n in names] for names in (sources, targets))
        parts = [pd.DataFrame({**dict(zip(keys, key)), "node": g.names, "metric": m, "value": METRICS[m](g, s, t)}) for m in metrics]
        return pd.concat(parts)

    return edges.select(*keys, "src", "dst", "weight").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", node string, metric string, value double")


def spectral_scores(edges: DataFrame, size: int, keys: Sequence[str] = ("exp",)) -> DataFrame:
    """(*keys, win, score): 1 minus the cosine of a window's principal vector with the typical one of the size before.

    The typical one is the first left singular vector of the last size vectors (Ide & Kashima 2004); null for the first
    windows, and where those vectors are all zero.
    """
    vectors = cut(centralities(edges, ["eigenvector"], (*keys, "win")).drop("metric"))
    return typical_angles(vectors, size, keys)


def typical_angles(vectors: DataFrame, size: int, keys: Sequence[str] = ("exp",)) -> DataFrame:
    """(*keys, win, score) of any vectors (*keys, win, node, value): 1 minus the cosine with the typical one of the size before.

    Only inner products of windows at most size apart are needed: with the vectors as columns of X, the typical one is
    X v / s, v and s^2 the leading eigenpair of X'X. They are grouped sums over a join by node, so a task never has a
    window's vector, whatever its length; the eigenpair is of a matrix of size rows.
    """
    types = dict(vectors.dtypes)
    # one row for each window
    ranks = vectors.select(*keys, "win").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("win")))
    x = cut(vectors.filter("value <> 0").join(ranks, [*keys, "win"]).select(*keys, "_k", "node", "value"))
    later = x.select(*keys, "node", F.col("_k").alias("_i"), F.col("value").alias("_x"), F.explode(F.sequence(F.col("_k"), F.col("_k") + size)).alias("_k"))
    dots = later.join(x, [*keys, "node", "_k"]).groupBy(*keys, "_i", F.col("_k").alias("_j")).agg(F.sum(F.col("_x") * F.col("value")).alias("_dot"))
    # a product of i and j belongs to the windows from j up to the last that looks back on i
    own = dots.select(*keys, F.explode(F.sequence(F.col("_j"), F.col("_i") + size)).alias("_k"), "_i", "_j", "_dot")
    own = own.filter(F.col("_k") > size).join(ranks, [*keys, "_k"])

    def run(key, pdf):
        first = pdf._k.iloc[0] - size
        g = np.zeros((size + 1, size + 1))
        i, j = pdf._i.to_numpy() - first, pdf._j.to_numpy() - first
        g[i, j] = g[j, i] = pdf._dot.to_numpy()
        value, vector = np.linalg.eigh(g[:size, :size])
        lead, length = value[-1], g[size, size]
        score = 1 - min(1.0, abs(float(vector[:, -1] @ g[:size, size])) / float(np.sqrt(lead * length))) if lead > 1e-12 and length > 0 else None
        return pd.DataFrame({**{k: [v] for k, v in zip([*keys, "win"], key)}, "score": pd.array([score], "Float64")})

    found = own.groupBy(*keys, "win").applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + f", win {types['win']}, score double")
    return ranks.drop("_k").join(found, [*keys, "win"], "left")

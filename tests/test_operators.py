import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.functions import exprs as X
from windlass.operators import graph as G
from windlass.operators import identity as I
from windlass.operators import kernels as K
from windlass.operators import paths as P
from windlass.operators import sequence as S
from windlass.plans import scoring as C

NAN = None


@pytest.mark.parametrize(
    ("vectors", "size", "want"),
    [
        ([(1, 1)] * 4, 1, [NAN, 0, 0, 0]),
        ([(1, 1), (2, 2), (3, 3), (1, 1)], 2, [NAN, NAN, 0, 0]),
        ([(1, 1), (4, 2), (2, 4), (1000, 1000)], 2, [NAN, NAN, 0.5667292, 0]),
        ([(1, 1), (4, 2), (), (), (1000, 1000), (1000, 1000), (1000, 1000)], 2, [NAN, NAN, NAN, NAN, NAN, 0, 0]),
        ([(0, 0), (4, 2), (2, 4), (0, 0), (1000, 1000), (1000, 1000), (1000, 1000)], 2, [NAN, NAN, 0.6435011, NAN, 0.3217506, 0, 0]),
        ([(0, 0), (4, 2), (2, 4), (0, 0, 4), (1000, 1000, 3), (1000, 1000, 2), (1000, 1000)], 2, [NAN, NAN, 0.6435011, 1.5707963, 0.7833984, 0.0035355, 0.0017678]),
    ],
)
def test_sliding_angles(spark, vectors, size, want):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "win int, vector array<double>")
    got = [r.angle for r in S.sliding_angles(df, size, [], "win").orderBy("win").collect()]
    assert [g is None for g in got] == [w is None for w in want]
    assert all(w is None or abs(g - w) < 1e-6 for g, w in zip(got, want))


def _random_graph(seed, n=7):
    rng = random.Random(seed)
    e = [(a, b, float(rng.randint(1, 9))) for a, b in itertools.permutations(range(n), 2) if rng.random() < 0.4]
    return K.Graph([f"n{a}" for a, _, _ in e], [f"n{b}" for _, b, _ in e], [w for _, _, w in e])


def _all_shortest(g):
    """All shortest paths by enumeration of simple paths."""
    best: dict = {}

    def go(path, d):
        key = (path[0], path[-1])
        if len(path) > 1:
            old = best.get(key, (math.inf, []))
            if d < old[0] - 1e-9:
                best[key] = (d, [path])
            elif abs(d - old[0]) <= 1e-9:
                old[1].append(path)
        for v in g.out[path[-1]]:
            if v not in path:
                go([*path, v], d + 1 / g.w[path[-1], v])

    for s in range(g.n):
        go([s], 0.0)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_kernels_against_definitions(seed):
    g = _random_graph(seed)
    best = _all_shortest(g)
    b, sub, h = np.zeros(g.n), np.zeros(g.n), np.zeros(g.n)
    for (s, t), (d, paths) in best.items():
        h[t] += 1 / d
        for p in paths:
            for v in p:
                b[v] += 1 / len(paths)
                if v not in (s, t) and s in (0, 1) and t in (2, 3):
                    sub[v] += 1 / len(paths)
    assert np.allclose(K.betweenness(g), b / (g.n * (g.n - 1)))
    assert np.allclose(K.betweenness(g, [0, 1], [2, 3], False), sub / ((g.n - 1) * (g.n - 2)))
    assert np.allclose(K.harmonic(g), h)


@pytest.mark.parametrize("seed", range(4))
def test_current_flow(seed):
    g = _random_graph(seed)
    part = K.largest_component(g)
    c = (g.w + g.w.T)[np.ix_(part, part)]
    lap, n = np.diag(c.sum(1)) - c, len(part)
    want = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        rhs = np.zeros(n)
        rhs[s], rhs[t] = 1, -1
        p = np.linalg.lstsq(lap, rhs, rcond=None)[0]
        for v in set(range(n)) - {s, t}:
            want[v] += sum(c[v, u] * abs(p[v] - p[u]) for u in range(n)) / 2
    assert np.allclose(K.current_flow(g)[part], want * 2 / ((n - 1) * (n - 2)))


def test_load_of_a_line():
    g = K.Graph(list("abbc"), list("babc")[:2] + list("cb"), [1.0] * 4)
    assert K.load(g)[1] == K.load(g).max() > 0


def test_injection_amounts(spark):
    path = ["db_pod", "web_vip", "web_pod", "internet"]
    hops = P.concrete_hops(spark.createDataFrame([("p", path)], "path_id string, path array<string>"))
    edges = spark.createDataFrame([(0, s, t, 1, 10) for s, t in itertools.permutations(path, 2)], "win int, src string, dst string, frames long, weight long")
    d = hops.select(F.lit(0).alias("win"), "src", "dst", P.amount(F.lit(10000.0), 30).alias("bytes"))
    out = P.inject(edges, d).join(edges.withColumnsRenamed({"weight": "w", "frames": "f"}), ["win", "src", "dst"], "left")
    added = [r.weight - (r.w or 0) for r in out.collect() if r.weight != r.w]
    assert sorted(added) == [400] * 3 + [5000] * 3


def test_carried_amounts(spark):
    wins = spark.range(7).withColumnRenamed("id", "win")
    assert [r.amount for r in P.carried_amounts(wins, 40.0, 30).orderBy("win").collect()] == [0, 0, 60, 0, 0, 60, 0]
    assert [r.amount for r in P.carried_amounts(wins, 600.0, 30).orderBy("win").collect()] == [300] * 7


def test_outside_contraction(spark):
    rows = [(0, "gw", "a", 1, 5), (0, "a", "gw", 1, 7), (0, "a", "8.8.8.8", 1, 11), (0, "b", "gw", 1, 13), (0, "gw", "b", 1, 17), (0, "a", "b", 1, 1), (1, "gw", "a", 1, 5), (1, "a", "gw", 1, 7)]
    e = spark.createDataFrame(rows, "win int, src string, dst string, frames long, weight long")
    got = {(r.win, r.src, r.dst, r.weight) for r in G.outside_contraction(e, X.is_ip, "gw").collect()}
    assert got == {(0, "outside", "a", 5), (0, "a", "outside", 11), (0, "a", "b", 1), (1, "gw", "a", 5), (1, "a", "gw", 7)}


def test_log_and_services(spark):
    log = spark.createDataFrame([(0, "web", "10.0.0.1", "+", "d", "svc", None), (0, "p", "None", "+", "d", "pod", None), (1, "q", "10.0.0.2", "+", "d", "pod", "Terminating"), (1, "kubernetes", "10.0.0.3", "+", "d", "svc", None), (1, "kube-dns-1", "10.0.0.4", "+", "kube-system", "pod", None)], "t int, name string, ip string, op string, namespace string, entity string, status string")
    assert {r.name for r in I.admitted(log).collect()} == {"web_VIP", "kubernetes_VIP", "kube-dns-1"}
    assert {r.name for r in I.infrastructure(log).collect()} == {"kubernetes"}
    assert {r.svc for r in I.services(log).collect()} == {"web", "kubernetes"}


def test_best_f1_is_strict(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    r = C.best_f1(s).first()
    assert r.thr == 0.1 and abs(r.f1 - 6 / 7) < 1e-9
    assert C.corner_points(C.roc_points(s)).count() <= 4


def test_spectral_score_flags_a_change(spark):
    same = [(w, "a", "b", 10), (w, "b", "a", 9), (w, "c", "a", 1)] if (w := 0) else []
    rows = [(w, s, d, x) for w in range(8) for s, d, x in ([("a", "b", 10), ("b", "a", 9)] if w < 7 else [("c", "d", 10), ("d", "c", 9)])] + same
    e = spark.createDataFrame([("x", *r) for r in rows], "exp string, win long, src string, dst string, weight long")
    got = {r.win: r.score for r in K.spectral_scores(e, 3).collect()}
    assert got[0] is None and got[4] < 1e-6 and got[7] > 0.9


def test_typical_angles_against_the_singular_vector(spark):
    rng, size = random.Random(8), 4
    rows = [(e, 10 * w, f"n{k}", rng.gauss(k, 1)) for e in "xy" for w in range(12) for k in range(7) if rng.random() < 0.8]
    rows += [("z", w, f"n{w}", 1.0) for w in range(6)] + [("o", w, "n", 0.0) for w in range(6)]  # no node in common, nothing at all
    frame = spark.createDataFrame(rows, "exp string, win long, node string, value double")
    got = {(r.exp, r.win): r.score for r in K.typical_angles(frame, size).collect()}
    assert len(got) == 36
    for e in "xy":
        x = np.zeros((12, 7))
        for f, w, n, v in rows:
            if f == e:
                x[w // 10, int(n[1:])] = v
        for w in range(12):
            if w < size:
                assert got[e, 10 * w] is None
            else:
                u = np.linalg.svd(x[w - size:w].T, full_matrices=False)[0][:, 0]
                assert abs(got[e, 10 * w] - (1 - abs(u @ x[w]) / np.linalg.norm(x[w]))) < 1e-9
    assert got["z", 5] == 1 and got["o", 5] is None


def test_model_grid(spark):
    """Each model of the grid learns a plain rule and scores rows of another run."""
    from windlass.plans import models as L

    rng = random.Random(3)
    rows = [(i, rng.gauss(2 * (i % 2), 0.4), rng.gauss(0, 1), float(i % 2), int(i >= 60)) for i in range(90)]
    frame = spark.createDataFrame(rows, "win long, a double, b double, label double, is_test int")
    fitted = L.fit_grid({10: frame}, ["a", "b"], ("logistic", "bagging"))
    got = L.score_grid(fitted, {10: frame}, ["a", "b"]).filter("is_test = 1").collect()
    assert {r.model for r in got} == {"logistic", "bagging"} and {r.gran for r in got} == {10}
    assert sum((r.score > 0.5) == (r.label > 0.5) for r in got) >= 0.9 * len(got)

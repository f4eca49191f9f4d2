import numpy as np
import pytest

from windlass.operators import kernels as K
from windlass.operators.centrality import centralities


def _graph(seed, n=9):
    """Small whole weights, so that many ways are equally long; a node that none reaches, a loop and an edge without weight."""
    r = np.random.default_rng(seed)
    e = [(f"n{a}", f"n{b}", int(r.integers(1, 4))) for a in range(n) for b in range(n) if a != b and r.random() < 0.35]
    return e + [("far", "n0", 2), ("n1", "n1", 5), ("n2", "lone", 0), ("n0", "n1", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_their_definitions(spark, seed):
    graphs = {w: _graph(seed * 10 + w) for w in range(3)}
    frame = spark.createDataFrame([(w, *e) for w, es in graphs.items() for e in es], "win long, src string, dst string, weight long")
    metrics = ["betweenness", "betweenness_subset", "load", "harmonic"]
    got = {(r.win, r.node, r.metric): r.value for r in centralities(frame, metrics, sources=["n0", "n3"], targets=["n4", "n5", "n0"]).collect()}
    for w, es in graphs.items():
        g = K.Graph(*zip(*es))
        at = {n: i for i, n in enumerate(g.names)}
        want = {"betweenness": K.betweenness(g), "betweenness_subset": K.betweenness(g, [at["n0"], at["n3"]], [at["n4"], at["n5"], at["n0"]], False), "load": K.load(g), "harmonic": K.harmonic(g)}
        for m in metrics:
            assert np.allclose([got[w, n, m] for n in g.names], want[m]), m
    assert len(got) == sum(len({x for s, d, _ in es for x in (s, d)}) for es in graphs.values()) * 4
    assert any(v > 0 for (_, _, m), v in got.items() if m == "betweenness_subset")


def test_only_sources_of_a_subset_and_empty_graphs(spark):
    frame = spark.createDataFrame([(0, *e) for e in _graph(5)], "win long, src string, dst string, weight long")
    part = {(r.node): r.value for r in centralities(frame, ["betweenness_subset"], sources=["n0"], targets=["n4", "n5"]).collect()}
    whole = {r.node: r.value for r in centralities(frame, ["betweenness_subset", "harmonic"], sources=["n0"], targets=["n4", "n5"]).filter("metric = 'betweenness_subset'").collect()}
    assert part.keys() == whole.keys() and all(part[k] == pytest.approx(whole[k]) for k in part)
    assert centralities(frame.limit(0), ["betweenness", "load", "harmonic"]).collect() == []

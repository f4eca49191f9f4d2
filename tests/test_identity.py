import random

from pyspark.sql import functions as F

from windlass.functions.exprs import matches_service
from windlass.operators import graph as G
from windlass.operators import identity as I
from windlass.operators import paths as P


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_as_of_with_a_hot_key_over_ranges(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", "c", None])
    versions = [(key(), rng.randint(0, 40) * 5, f"s{i}") for i in range(150)] + [("hot", 5, "z"), ("hot", 5, "y")]
    probes = [(i, key(), rng.randint(-20, 300)) for i in range(900)]
    p, v = spark.createDataFrame(probes, "id long, key string, at long"), spark.createDataFrame(versions, "key string, since long, status string")
    want = []
    for i, k, t in probes:
        seen = [(s, n) for q, s, n in versions if q == k and s < t]
        want.append((i, k, t, max(seen)[1] if seen else None))
    for rows in (40, 300, 10_000):
        assert _rows(I.as_of(p, v, "key", "at", "since", ["status"], rows)) == sorted(want, key=str)
    assert I.as_of(p.limit(0), v, "key", "at", "since", ["status"]).count() == 0
    assert {r.status for r in I.as_of(p, v.limit(0), "key", "at", "since", ["status"]).collect()} == {None}


def test_patterns_meet_by_key_alone(spark):
    rng = random.Random(5)
    parts = ["ab", "a", "cart", "db", "kube-dns", "front-end", "user"]
    svcs = sorted({"-".join(rng.choices(parts, k=rng.randint(1, 2))) for _ in range(25)})
    tails = ["-3", "-", "", "_VIP", "-abcdefgh1", "-x", "-12345678"]
    names = sorted({rng.choice(["", "x", "pre-"]) + rng.choice([*svcs, "coredns", "none"]) + rng.choice(tails) for _ in range(300)})
    n, s = spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame([(x,) for x in [*svcs, ""]], "svc string")
    got = I.pattern_hits(n, s)
    want = n.crossJoin(s.filter("svc <> ''")).filter(matches_service(F.col("node"), F.col("svc")))
    assert _rows(got) == _rows(want) and got.count() > 100
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_shared_labels(spark):
    svcs = spark.createDataFrame([("front", ["app=a", "k8s-app=s"]), ("fro", ["app=a"]), ("zz", ["k8s-app=s"])], "svc string, labels array<string>")
    nodes = spark.createDataFrame([("n1", ["app=a"]), ("n2", ["k8s-app=s", "app=none"]), ("n3", [])], "node string, labels array<string>")
    assert _rows(I.by_label(nodes, svcs)) == [("n1", "fro"), ("n2", "zz")]


def test_infrastructure_nodes(spark):
    nodes = spark.createDataFrame([("heapster-1",), ("heapster_VIP",), ("my-heapster_VIP",), ("web_VIP",), ("tiller-7",)], "node string")
    infra = spark.createDataFrame([("tiller-7", "pod"), ("web", "pod"), ("heapster", "svc"), (None, "svc")], "name string, entity string")
    assert [r[0] for r in _rows(I.infrastructure_nodes(nodes, infra))] == ["heapster_VIP", "my-heapster_VIP", "tiller-7"]


def test_valid_paths(spark):
    cases = {
        ("a_pod", "a_vip", "b_pod"): True, ("a_pod", "c_vip", "b_pod"): False, ("a_pod", "a_vip", "user_db_pod"): False, ("a_pod", "user_db_vip", "user_db_pod"): True,
        ("user_db_pod", "b_vip", "b_pod"): False, ("a_vip",): False, ("a_pod", "b_pod"): True,
    }
    df = spark.createDataFrame([(list(p),) for p in cases], "p array<string>")
    assert {tuple(r.p): r.ok for r in df.select("p", P.is_valid(F.col("p")).alias("ok")).collect()} == cases


def test_pairs_without_edges(spark):
    m = spark.createDataFrame([(1, "a", "b", 0.5, None), (2, "a", "a", 0.1, 2.0)], "win int, svc_a string, svc_b string, reciprocity double, cov double")
    n = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "b")], "node string, svc string")
    got = _rows(G.every_pair(m, n, {"reciprocity": -1.0, "cov": 0.0}))
    assert got == [(1, "a", "a", -1.0, 0.0), (1, "a", "b", 0.5, None), (1, "b", "b", -1.0, 0.0), (2, "a", "a", 0.1, 2.0), (2, "a", "b", -1.0, 0.0), (2, "b", "b", -1.0, 0.0)]
    assert G.every_pair(m.limit(0), n, {"reciprocity": -1.0}).count() == 0

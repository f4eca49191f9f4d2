from pyspark.sql import functions as F

from windlass.operators.paths import choose_node
from windlass.plans import features as M
from windlass.plans.scoring import corner_points


def test_every_named_drop_goes(spark):
    rows = spark.createDataFrame([(0, m, 1.0) for m in (*M.DROPPED, "kept", "plain_")], "win int, metric string, value double")
    assert sorted(r.metric for r in M.pruned(rows).collect()) == ["kept", "plain_"]
    assert {"Communication Not Through VIPs", "Communication Between Pods not through VIPs (w abs)_"} <= set(M.DROPPED)


def test_corner_points_leave_the_curve_as_it_is(spark):
    points = [(9.0, 0, 0), (8.0, 1, 0), (7.0, 2, 0), (6.0, 3, 0), (5.0, 3, 2), (4.0, 3, 4), (3.0, 4, 5), (2.0, 5, 6), (1.0, 5, 7)]
    frame = spark.createDataFrame(points, "thr double, tp long, fp long")
    got = [tuple(r) for r in corner_points(frame).orderBy(F.desc("thr")).collect()]
    flat = lambda i: 0 < i < len(points) - 1 and all(points[i][k] - points[i - 1][k] == points[i + 1][k] - points[i][k] for k in (1, 2))
    assert got == [p for i, p in enumerate(points) if not flat(i)] and len(got) == 5


def test_nodes_are_chosen_by_seed_alone(spark):
    nodes = spark.createDataFrame([(f"{s}-{k}", s) for s in "abc" for k in range(8)], "node string, svc string")
    hops = spark.createDataFrame([("a",), ("c",), ("none",)], "svc string")
    pick = lambda seed, n: {r.svc: r.node for r in choose_node(hops, nodes.repartition(n), seed).collect()}
    one = pick(1, 2)
    assert one == pick(1, 5) and one["none"] is None and one["a"].startswith("a-") and one["c"].startswith("c-")
    assert len({pick(s, 1)["a"] for s in range(12)}) > 3

import random

from windlass.llm.common import Scratch, components


def test_components_of_both_ways(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent}
    for small in (10**6, 0):
        got = {r.id: r.component_id for r in components(df, Scratch(spark, "t"), small=small).collect()}
        assert got == want
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0

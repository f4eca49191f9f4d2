import random

import numpy as np

from windlass.operators import ranks as R


def test_running_totals(spark):
    rng = random.Random(4)
    rows = {(k, rng.choice([rng.random(), float(rng.randint(0, 5))])): rng.randint(1, 9) for k in "ab" for _ in range(500)}
    df = spark.createDataFrame([(k, v, n) for (k, v), n in rows.items()], "k string, v double, n long")
    for down in (False, True):
        for size in (50, 10_000):  # over many ranges, and without any
            got = {(r.k, r.v): r.run_n for r in R.running(df, "v", ["n"], ["k"], down, range_rows=size).collect()}
            for k in "ab":
                total = 0
                for v in sorted((v for q, v in rows if q == k), reverse=down):
                    total += rows[k, v]
                    assert got[k, v] == total
    assert [r.run_n for r in R.running(df.filter("k = 'a'").limit(1), "v", ["n"]).collect()]


def test_quantiles(spark):
    rng = random.Random(5)
    values = {k: [rng.choice([None, rng.randint(0, 20), rng.random()]) for _ in range(n)] for k, n in (("a", 300), ("b", 7), ("c", 1))}
    values["c"] = [2.5]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.q for r in R.quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), ["k"], 40).collect()}
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile([v for v in vs if v is not None], (0.0, 0.25, 0.5, 0.9, 1.0)))
    assert R.quantiles(df.limit(0), "v", (0.5,), ["k"]).count() == 0

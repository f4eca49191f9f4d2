import math
import random

import numpy as np
import pytest

from windlass.functions.exprs import normal
from windlass.operators import scan
from windlass.operators.scan import carried


def brute(rates, seconds, least=60):
    carry, out = 0, []
    for x in rates:
        amount = math.floor((max(x or 0.0, 0.0) + carry) * seconds / 60)
        carry = amount if amount < least else 0
        out.append((amount, amount if amount >= least else 0))
    return out


@pytest.mark.parametrize("seconds", [10, 60, 90])
def test_equals_the_recurrence_over_several_levels(spark, monkeypatch, seconds):
    monkeypatch.setattr(scan, "BLOCK", 8)
    rng = random.Random(seconds)
    rates = {k: [rng.choice([None, -40.0, 0.0, rng.uniform(0, 90), rng.uniform(0, 400)]) for _ in range(n)] for k, n in (("a", 700), (None, 90), ("b", 1))}
    rows = [(k, 5 + 3 * i, x, "junk") for k, xs in rates.items() for i, x in enumerate(xs)]
    got = carried(spark.createDataFrame(rows, "path string, win long, rate double, amount string"), ["path"], "win", "rate", seconds).collect()
    want = [(k, 5 + 3 * i, *v) for k, xs in rates.items() for i, v in enumerate(brute(xs, seconds))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_blocks_are_bounded_and_empty_tables_stay_empty(spark):
    rows = spark.range(3000).selectExpr("1 as path", "id as win", "16.0D as rate")
    assert [r.sent for r in carried(rows, ["path"], "win", "rate", 60).orderBy("win").collect()] == [64 if w % 4 == 3 else 0 for w in range(3000)]
    assert carried(rows.limit(0), ["path"], "win", "rate", 60).collect() == []


def test_draws_are_normal_and_fixed_by_their_seed(spark):
    from pyspark.sql import functions as F

    made = lambda n: spark.range(0, 20_000, 1, n).select(normal(F.lit(10.0), 2.0, F.lit(7), F.col("id")).alias("x"), "id").orderBy("id")
    x = np.array([r.x for r in made(3).collect()])
    assert abs(x.mean() - 10) < 0.06 and abs(x.std() - 2) < 0.06 and abs((x < 8).mean() - 0.1587) < 0.01
    assert [r.x for r in made(8).collect()] == x.tolist()

import random

import pytest

from windlass.operators.intervals import first_overlap, overlapping


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_a_plain_comparison(spark, seed):
    rng = random.Random(seed)
    cut = lambda: (lambda a, n: (a, a + n))(rng.randrange(-500, 500), rng.choice([0, 1, 1, 2, 3, 8, 9, 64, 700, 10**6]))
    left = [(i, *cut()) for i in range(150)] + [(900, None, 5), (901, 3, None), (7, -3, 4), (7, -3, 4)]
    right = [(i % 40, *cut()) for i in range(120)] + [(1, None, None)]
    a, b = spark.createDataFrame(left, "id long, lo long, hi long"), spark.createDataFrame(right, "period_id long, start long, end long")
    meet = lambda x, y: None not in (*x, *y) and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]
    want = [(*x, *y) for x in left for y in right if meet(x, y)]
    assert sorted(map(tuple, overlapping(a, b).collect())) == sorted(want)
    first = [(*x, min((y[0] for y in right if meet(x, y)), default=None)) for x in left]
    assert sorted(map(tuple, first_overlap(a, b, "period_id").collect()), key=str) == sorted(first, key=str)


def test_plan_has_no_comparison_of_all_pairs(spark):
    a = spark.range(1000).selectExpr("id", "id * 7 as lo", "id * 7 + 20 as hi")
    b = spark.range(1000).selectExpr("id as period_id", "id * 9 as start", "id * 9 + 4 as end")
    plan = overlapping(a, b)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) >= 2 and all("_cell" in line or "_levels" in line or line.strip(" :+-").startswith("Join Inner, rightHint") or "broadcast" in line for line in joins)


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 0, 5)], "id long, lo long, hi long")
    b = spark.createDataFrame([], "period_id long, start long, end long")
    assert overlapping(a, b).collect() == [] and [tuple(r) for r in first_overlap(a, b, "period_id").collect()] == [(1, 0, 5, None)]

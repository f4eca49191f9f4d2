import numpy as np

from windlass.plans.rates import lowered, retrained


def test_rows_of_chosen_rates(spark):
    rows = [(r, w, p, r * 10.0) for r in (1, 5, 10) for w, p in enumerate(["a", None, "b", "a", "c"])]
    frame = spark.createDataFrame(rows, "rate int, win int, path string, x double")
    chosen = spark.createDataFrame([("a", 1), ("b", 5), ("nowhere", 1)], "path string, rate int")
    got = sorted((r.win, r.path, r.rate) for r in lowered(frame, chosen).collect())
    assert got == [(0, "a", 1), (1, None, 10), (2, "b", 5), (3, "a", 1), (4, "c", 10)]
    two = frame.selectExpr("'x' as exp", "*").unionByName(frame.filter("rate < 10").selectExpr("'y' as exp", "*"))
    pick = spark.createDataFrame([("x", "a", 5), ("y", "b", 1)], "exp string, path string, rate int")
    got = {(r.exp, r.win): r.rate for r in lowered(two, pick, ["exp"]).collect()}
    assert got == {("x", 0): 5, ("x", 1): 10, ("x", 2): 10, ("x", 3): 5, ("x", 4): 10, ("y", 0): 5, ("y", 1): 5, ("y", 2): 1, ("y", 3): 5, ("y", 4): 5}


def test_planted_rates_are_found_and_trained_on(spark):
    """Path a shows at every rate, path b from rate 5 on, path c at rate 10 only."""
    r = np.random.default_rng(1)
    least, rows = {"a": 1, "b": 5, "c": 10}, []
    for rate in (1, 5, 10):
        for w in range(400):
            path = ["a", "b", "c"][w // 4 % 3] if w % 4 == 0 else None
            seen = path is not None and rate >= least[path]
            rows.append((rate, w, path, float(path is not None), int(w >= 200), float(seen * 5 + r.normal(0, 0.5)), float(r.normal())))
    frame = spark.createDataFrame(rows, "rate int, win long, path string, label double, is_test int, m double, n double")
    model, chosen, merged = retrained(frame, ["m", "n"])
    assert {x.path: x.rate for x in chosen.collect()} == least
    assert merged.count() == 400 and {(x.path, x.rate) for x in merged.select("path", "rate").distinct().collect()} == {("a", 1), ("b", 5), ("c", 10), (None, 10)}
    got = model.scored(merged.filter("is_test = 1")).collect()
    assert min(x.score for x in got if x.label) > max(x.score for x in got if not x.label)

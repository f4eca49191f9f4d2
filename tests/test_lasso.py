import numpy as np
import pytest

from windlass.operators.ranks import contiguous_folds, numbered
from windlass.plans.lasso import Lasso, descend, grams, multi_granularity, rebucketed_scores, strengths


def _frame(spark, n=230, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(1000, [1, 5, 20, 1, 3, 2], (n, 6))
    x[:, 4] = x[:, 1] + r.normal(0, 0.5, n)
    y = 0.5 * (x[:, 0] - 1000) - 0.2 * (x[:, 1] - 1000) + r.normal(0, 0.3, n) + 7
    x[:, 5] = 3.0
    win = r.permutation(n * 3)[:n]
    order = np.argsort(win)
    rows = [(int(win[i]), *map(float, x[i]), float(y[i])) for i in range(n)]
    names = [f"m.{k}" for k in range(6)]
    return spark.createDataFrame(rows, ["win", *names, "label"]), names, x[order], y[order]


def _kkt(x, y, w, b, a):
    """The optimum's conditions: a metric in use has a slope of exactly the strength, another one of at most it."""
    r = y - x @ w - b
    slope = x.T @ r / len(y)
    assert abs(r.mean()) < 1e-6
    assert np.all(np.abs(slope[w == 0] - r.mean() * x.mean(0)[w == 0]) <= a + 1e-6)
    assert np.allclose(slope[w != 0] - r.mean() * x.mean(0)[w != 0], a * np.sign(w[w != 0]), atol=1e-6)


def _plain(x, y, folds, n=100, eps=1e-3):
    """Cross-validation with data in memory, fits from scratch for each strength."""
    def fit(x, y, a):
        xc, yc = x - x.mean(0), y - y.mean()
        w = descend(xc.T @ xc / len(y), xc.T @ yc / len(y), a, np.zeros(x.shape[1]))
        return w, y.mean() - x.mean(0) @ w

    path = strengths((x - x.mean(0)).T @ (y - y.mean()) / len(y), n, eps)
    sizes = [len(y) // folds + (k < len(y) % folds) for k in range(folds)]
    ends = np.cumsum([0, *sizes])
    errors = np.zeros(len(path))
    for s, e in zip(ends[:-1], ends[1:]):
        out = np.r_[0:s, e:len(y)]
        for k, a in enumerate(path):
            w, b = fit(x[out], y[out], a)
            errors[k] += np.mean((y[s:e] - x[s:e] @ w - b) ** 2) / folds
    return path, errors, fit(x, y, path[errors.argmin()])


def test_path_equals_cross_validation_in_memory(spark, tmp_path):
    frame, names, x, y = _frame(spark)
    model = Lasso.fit(frame, names, folds=4, n=30)
    path, errors, (w, b) = _plain(x, y, 4, 30)
    assert np.allclose([a for a, _ in model.path], path) and np.allclose([e for _, e in model.path], errors, rtol=1e-6)
    assert np.allclose(model.coef, w, atol=1e-6) and model.intercept == pytest.approx(b, abs=1e-3)
    _kkt(x, y, model.coef, model.intercept, model.strength)
    assert model.coef[5] == 0 and model.coef[0] > 0.4
    got = np.array([r.score for r in model.scored(frame).orderBy("win").collect()])
    assert np.allclose(got, x @ model.coef + model.intercept)
    model.save(spark, str(tmp_path / "model"))
    again = Lasso.load(spark, str(tmp_path / "model"))
    assert [r.score for r in again.scored(frame).orderBy("win").collect()] == got.tolist() and again.path == model.path
    assert {r.metric: r.coef for r in model.coefficients(spark).collect()}["m.0"] == model.coef[0]


def test_descent_meets_the_conditions_at_every_strength():
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 20)) @ r.normal(size=(20, 20))
    y = x[:, 0] - 2 * x[:, 3] + r.normal(size=60)
    xc, yc = x - x.mean(0), y - y.mean()
    q, c = xc.T @ xc / 60, xc.T @ yc / 60
    w, used = np.zeros(20), []
    for a in strengths(c, 15):
        w = descend(q, c, a, w)
        _kkt(xc, yc, w, 0.0, a)
        used.append((w != 0).sum())
    assert used[0] == 0 and used[-1] > 10


def test_grams_are_sums_of_products(spark):
    frame, names, x, y = _frame(spark, 50)
    means, by = grams(contiguous_folds(frame, 3, ["win"]), names, "label", "fold")
    z = np.column_stack([np.ones(50), np.column_stack([x, y]) - means])
    ends = [0, 17, 34, 50]
    assert sorted(by) == [0, 1, 2] and all(np.allclose(by[k], z[ends[k]:ends[k + 1]].T @ z[ends[k]:ends[k + 1]]) for k in by)


def test_nulls_and_too_few_rows_are_errors(spark):
    frame, names, *_ = _frame(spark, 20)
    with pytest.raises(ValueError, match="null"):
        Lasso.fit(frame.union(frame.limit(1).selectExpr("1000", *["cast(null as double)"] * 6, "1.0")), names, folds=2)
    with pytest.raises(ValueError, match="folds"):
        Lasso.fit(frame.limit(2), names, folds=5)


def test_numbers_go_on_over_ranges(spark):
    rows = spark.range(3000).selectExpr("id * 7919 % 3001 as a")
    assert [r.pos for r in numbered(rows, ["a"], range_rows=100).orderBy("a").collect()] == list(range(3000))


def test_granularities_together(spark):
    r = np.random.default_rng(3)
    base = r.random(400) < 0.15
    fine = [(i, float(base[i]), int(i >= 300), float(base[i] * 2 + r.normal(0, 0.4)), float(r.normal())) for i in range(400)]
    coarse = [(i, float(base[4 * i:4 * i + 4].any()), int(i >= 75), float(base[4 * i:4 * i + 4].sum() + r.normal(0, 0.8)), float(r.normal())) for i in range(100)]
    schema = "win long, label double, is_test int, a double, b double"
    frames = {10: spark.createDataFrame(fine, schema), 40: spark.createDataFrame(coarse, schema)}
    last, fitted, rows = multi_granularity(frames, ["a", "b"])
    got = {x.win: x for x in rows.collect()}
    assert sorted(got) == list(range(100)) and last.metrics == ["10", "40"]
    one = np.array([x.score for x in fitted[10].scored(frames[10]).orderBy("win").collect()])
    assert all(got[w]["10"] == pytest.approx(one[4 * w:4 * w + 4].max()) for w in got)
    test = [w for w in got if got[w].is_test]
    hit = np.array([got[w].score for w in test if got[w].label])
    assert hit.mean() > np.mean([got[w].score for w in test if not got[w].label]) + 0.4
    parts = spark.createDataFrame([("x", 10, 0, 1.0), ("x", 10, 3, 5.0), ("x", 10, 4, 2.0), ("x", 40, 0, 7.0), ("y", 10, 9, 3.0)], "exp string, gran int, win long, score double")
    assert sorted(map(tuple, rebucketed_scores(parts, ["exp"]).collect())) == [("x", 0, "10", 5.0), ("x", 0, "40", 7.0), ("x", 1, "10", 2.0), ("y", 2, "10", 3.0)]

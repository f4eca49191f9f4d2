import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from windlass.plans import boosting, trees
from windlass.plans.lasso import Lasso
from windlass.plans.models import assembled, forest, scored


def _data(spark, n=160, seed=2):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)).astype(float)
    x[:, 2] += r.random(n) * 0.001
    y = (x[:, 0] > 6) * 2.0 + x[:, 1] * 0.1 + r.normal(0, 0.2, n)
    rows = [(i, *map(float, x[i]), float(y[i]), float(y[i] > 1.4)) for i in range(n)]
    return spark.createDataFrame(rows, "win long, a double, b double, c double, y double, label double"), x, y


def _weighted_tree(x, y, w, depth):
    """A plain regression tree: all midpoints of all metrics, least weighted squared error."""
    mean = np.average(y, weights=w)
    best = None
    if depth and len(y) > 1:
        whole = (w * (y - mean) ** 2).sum()
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for c in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= c
                err = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))
                if err < whole - 1e-12 and (best is None or err < best[0] - 1e-12):
                    best = (err, j, c)
    if best is None:
        return lambda z: np.full(len(z), mean)
    _, j, c = best
    left = x[:, j] <= c
    lo, hi = _weighted_tree(x[left], y[left], w[left], depth - 1), _weighted_tree(x[~left], y[~left], w[~left], depth - 1)
    return lambda z: np.where(z[:, j] <= c, lo(z), hi(z))


def _plain_r2(x, y, learn, rounds):
    w, found = np.ones(len(y)), []
    for _ in range(rounds):
        f = learn(x, y, w)
        e = np.abs(f(x) - y) / np.abs(f(x) - y).max()
        mean = (w * e).sum() / w.sum()
        if mean >= 0.5:
            break
        beta = mean / (1 - mean)
        found.append((math.log(1 / beta), f))
        w = w * beta ** (1 - e)
        w *= len(y) / w.sum()

    def score(z):
        out = []
        for i in range(len(z)):
            pairs, total = sorted((float(f(z[i:i + 1])[0]), a) for a, f in found), 0.0
            for p, a in pairs:
                total += a
                if total >= sum(a for a, _ in found) / 2 * (1 - 1e-12):
                    out.append(p)
                    break
        return np.array(out)

    return found, score


def test_r2_over_trees_equals_the_sequential_form(spark):
    frame, x, y = _data(spark)
    frame = frame.drop("c")
    x = x[:, :2]
    model = boosting.R2(boosting.tree(depth=2), rounds=5).fit(frame, ["a", "b"], "y")
    found, score = _plain_r2(x, y, lambda x, y, w: _weighted_tree(x, y, w, 2), 5)
    assert len(model.fitted) == len(found) > 2
    assert np.allclose([a for a, _ in model.fitted], [a for a, _ in found], atol=1e-6)
    got = np.array([r.score for r in model.scored(frame).orderBy("win").collect()])
    assert np.allclose(got, score(x), atol=1e-9)


def test_r2_over_lasso_equals_the_sequential_form(spark):
    frame, x, y = _data(spark)
    n = len(y)

    def learn(x, y, w):
        z = np.column_stack([np.ones(n), x - x.mean(0), y - y.mean()])
        fold = np.repeat(np.arange(4), n // 4)
        m = Lasso.of(np.append(x.mean(0), y.mean()), {k: (z[fold == k] * w[fold == k, None]).T @ z[fold == k] for k in range(4)}, ["a", "b", "c"], 4, 20)
        return lambda q: q @ m.coef + m.intercept

    model = boosting.R2(boosting.lasso(4, 20), rounds=4).fit(frame, ["a", "b", "c"], "y", folds=4)
    found, score = _plain_r2(x, y, learn, 4)
    assert len(model.fitted) == len(found) >= 2
    got = np.array([r.score for r in model.scored(frame).orderBy("win").collect()])
    assert np.allclose(got, score(x), atol=1e-5)


@pytest.mark.parametrize("learner", ["stump", "logistic"])
def test_samme_r_equals_the_sequential_form(spark, learner):
    frame, x, y = _data(spark)
    # a stump of MLlib tries all midpoints of a metric only if its values are few
    names = ["a", "b"] if learner == "stump" else ["a", "b", "c"]
    model = boosting.SammeR(getattr(boosting, learner)(), rounds=4).fit(frame, names)
    label, w, odds = (y > 1.4).astype(float), np.ones(len(y)), []
    for _ in range(len(model.fitted)):
        if learner == "stump":
            best = None
            for j in range(2):
                values = np.unique(x[:, j])
                for c in (values[1:] + values[:-1]) / 2:
                    left = x[:, j] <= c
                    gini = sum((w[s].sum() * (1 - sum((w[s][label[s] == k].sum() / w[s].sum()) ** 2 for k in (0, 1)))) for s in (left, ~left))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, left)
            p = np.where(best[1], *(np.average(label[s], weights=w[s]) for s in (best[1], ~best[1])))
        else:
            data = spark.createDataFrame([(i, *map(float, x[i]), float(label[i]), float(w[i])) for i in range(len(y))], "win long, a double, b double, c double, label double, w double")
            fitted = LogisticRegression(labelCol="label", weightCol="w", regParam=0.01).fit(assembled(data, names))
            p = 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept)))
        p = np.clip(p, 2.220446049250313e-16, 1 - 2.220446049250313e-16)
        odds.append(np.log(p / (1 - p)))
        w = w * np.exp(-0.5 * np.where(label > 0.5, 1, -1) * odds[-1])
        w *= len(y) / w.sum()
    got = np.array([r.score for r in model.scored(frame).orderBy("win").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-np.mean(odds, 0))), atol=1e-4)
    assert ((got > 0.5) == (label > 0.5)).mean() > 0.85


def _plain_extra(x, y, seed, t, depth, tries, least=2):
    """One tree by recursion over rows in memory: (node, rows) of the leaves."""
    out = []

    def grow(node, rows, level):
        n1 = int(y[rows].sum())
        if level < depth and 0 < n1 < len(rows) and len(rows) >= least:
            splits = trees.draw(seed, t, node, x[rows].min(0), x[rows].max(0), tries)
            counts = np.array([[[((x[rows, m] > c) == s)[y[rows] == k].sum() for k in (0, 1)] for s in (False, True)] for m, c in splits]).reshape(-1, 2, 2)
            if chosen := trees.best(splits, counts):
                right = x[rows, chosen[0]] > chosen[1]
                grow(2 * node, rows[~right], level + 1)
                grow(2 * node + 1, rows[right], level + 1)
                return
        out.append((node, rows, n1 / len(rows)))

    grow(1, np.arange(len(y)), 0)
    return out


def test_extra_trees_equal_recursion_with_the_same_draws(spark):
    frame, x, y = _data(spark)
    label = (y > 1.4).astype(int)
    model = trees.ExtraTrees(trees=4, depth=5, tries=2, seed=9).fit(frame.repartition(5), ["a", "b", "c"])
    want = np.zeros(len(y))
    for t in range(4):
        leaves = _plain_extra(x, label, 9, t, 5, 2)
        assert {k for u, k in model.leaves if u == t} == {k for k, _, _ in leaves}
        for _, rows, share in leaves:
            want[rows] += share / 4
    got = np.array([r.score for r in model.scored(frame).orderBy("win").collect()])
    assert np.allclose(got, want)
    assert ((got > 0.5) == label).mean() > 0.85
    other = trees.ExtraTrees(trees=4, depth=5, tries=2, seed=10).fit(frame, ["a", "b", "c"])
    assert other.trees != model.trees


def test_extra_trees_of_one_class_and_of_equal_rows(spark):
    one = spark.createDataFrame([(i, float(i), 1.0) for i in range(5)], "win long, a double, label double")
    assert {r.score for r in trees.ExtraTrees(2).fit(one, ["a"]).scored(one).collect()} == {1.0}
    same = spark.createDataFrame([(i, 3.0, float(i % 4 == 0)) for i in range(8)], "win long, a double, label double")
    assert {r.score for r in trees.ExtraTrees(2).fit(same, ["a"]).scored(same).collect()} == {0.25}


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_training_rows_of_one_class_give_its_score(spark, label):
    rows = spark.createDataFrame([(i, float(i % 5), label) for i in range(20)], "win long, a double, label double")
    models = [boosting.SammeR(boosting.stump(), 3).fit(rows, ["a"]).scored(rows), boosting.SammeR(boosting.logistic(), 3).fit(rows, ["a"]).scored(rows), scored(forest(rows, ["a"], trees=3), rows, ["a"])]
    for got in models:
        assert [r.score for r in got.collect()] == pytest.approx([label] * 20, abs=1e-9)

"""Models over the tables: held-out windows are told apart, and a grid's names all fit and score."""

import pytest

from windlass import model_queries as Q
from windlass.plans.models import GRID, fit_grid, score_grid

from .oracle import DATA

SF = f"{DATA}/sf0.001"


def _apart(rows):
    one, zero = ([r.score for r in rows if r.is_test and r.label == k] for k in (1.0, 0.0))
    assert one and zero
    wins = sum((a > b) + (a == b) / 2 for a in one for b in zero)
    return wins / len(one) / len(zero)


@pytest.mark.parametrize("name", ["lasso_path_scores", "multi_granularity_scores", "boosting_regressor_scores", "boosting_lasso_scores", "boosting_classifier_scores", "boosting_logistic_scores", "extra_trees_scores"])
def test_held_out_windows_are_told_apart(spark, name):
    rows = getattr(Q, name)(spark, SF).collect()
    assert len(rows) == len({r.win for r in rows}) > 300 // (7 if "multi" in name else 1)
    assert _apart(rows) > 0.8


def test_every_name_of_the_grid(spark):
    frame = Q._frame(spark, SF, 7)
    names = [n for n in GRID if n not in ("lasso", "logistic", "logistic_l1", "logistic_cv", "forest", "bagging", "boosting")]
    fitted = fit_grid({7: frame}, Q.METRICS, names)
    got = score_grid(fitted, {7: frame}, Q.METRICS).groupBy("gran", "model").agg({"score": "stddev"}).collect()
    assert sorted(r.model for r in got) == sorted(names) and all(r["stddev(score)"] > 0 for r in got)

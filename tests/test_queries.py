import pytest

from windlass import ego_queries, injection_queries, model_queries, plan_queries, queries, scan_queries, stream_queries  # noqa: F401
from windlass.queries import ORACLE, QUERIES

from .oracle import DATA, canonical, sql_rows

SF = f"{DATA}/sf0.01"


def norm(rows):
    def cell(x):
        try:
            return str(float(x))
        except ValueError:
            return x

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql_rows(SF, ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    a, b = canonical(got.apply(lambda c: c.astype(float) if c.dtype.kind == "f" else c)), canonical(want)
    assert norm(a) == norm(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["lasso_scores", "forest_scores", "logistic_scores", "boosting_scores", "outbound_total", "hub_ratio", "feature_pivot", "current_flow"])
def test_varied(spark, name):
    """These are fitted on or computed from parts of the tables that exist."""
    got = QUERIES[name](spark, SF).toPandas()
    value = next(c for c in ("score", "out_weight", "value", "NATION_3_weight") if c in got)
    assert got[value].nunique() > 1


def test_the_frame_of_the_models_is_made_once(spark):
    """Fits read the written rows, not the tables behind them again and again."""
    frame = queries._frame(spark, SF)
    assert not frame.inputFiles() and frame.count() == 28

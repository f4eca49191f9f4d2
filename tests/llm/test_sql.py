import pytest

from windlass.llm.queries import ORACLE, QUERIES

from ..oracle import DATA, canonical, sql_rows

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql_rows(SF, ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    plain = lambda rows: sorted(tuple(x.removesuffix(".0") for x in r) for r in rows)
    assert plain(canonical(got)) == plain(canonical(want))

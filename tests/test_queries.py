"""Every query that SQL can express against DuckDB; the others run and keep their schema."""

import pytest
from tests.conftest import SF, as_sorted

import __spark_entry__
from tidestate import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    got, want = as_sorted(queries.QUERIES[name](spark, SF).toPandas()), as_sorted(duck.execute(queries.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert (got.values == want.values).all()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.limit(3).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["series_id", "t", "y", "m", "p", "ll"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_plan(spark, capsys):
    """One exchange, a pruned scan, no Python."""
    queries.kf_filter(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Exchange (") <= 2 and "Python" not in plan and "Arrow" not in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]

import pytest
from oracle import check

from spanmill.plans import problems, records, trace

CASES = {name: (f, m.ORACLE.get(name)) for m in (problems, trace, records) for name, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if sql])
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, *CASES[name])


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if not sql])
def test_query_runs(spark, sf_dir, name):
    assert CASES[name][0](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

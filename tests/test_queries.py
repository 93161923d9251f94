"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from termweave import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, same):
    same(catalog.queries()[name], SQL[name])


def test_entry_is_registered(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "rank" in e.entry(spark).columns


def test_flagship_reads_few_columns(spark, tmp_path):
    from termweave.operators import patterns as P
    from termweave.catalogs.graph import triples
    from termweave.model import SUB
    from termweave.operators.patterns import Var

    df = P.match(triples(spark, "/root/testdata/sf0.001"), Var("x"), SUB, Var("y"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "p_name" not in plan  # other predicates' tables are not scanned

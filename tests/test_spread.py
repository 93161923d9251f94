"""Large tables are dealt in partitions of a bounded number of rows."""

from test_queries import SQL

from termweave import catalog, model
from termweave.plans import tables


def parts(df):
    return df.rdd.getNumPartitions()


def test_lines_are_dealt_by_their_number(spark, same, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 200)
    x = model.derive(spark, "/root/testdata/sf0.001")
    n = model.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert parts(x.class_expr) == n // 200 + 1 > 4
    same(catalog.queries()["x09_named_or_complex"], SQL["x09_named_or_complex"])

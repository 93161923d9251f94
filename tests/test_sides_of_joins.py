"""What a join sends to all tasks through the driver is bounded by rows."""

from pyspark.sql import functions as F
from test_operators import B, onto

from termweave.operators import reasoning
from termweave.plans import tables


def test_many_rows_are_shuffled_however_well_they_compress(spark, monkeypatch):
    t = tables.save(spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit("a").alias("v")))
    plan = lambda d: spark.range(9).withColumnRenamed("id", "k").join(d, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(tables.side(t))
    monkeypatch.setattr(tables, "SENT", 999)
    assert "SortMergeJoin" in plan(tables.side(t)) and "SortMergeJoin" in plan(tables.side(t.select("k").distinct(), t))


def test_normal_forms_send_few_rows(spark, monkeypatch):
    """What flatten() has read, and what is not supported, grows with the ontology; the forms are the same either way."""
    x = onto(spark, class_expr=[(f"{B}C{i}", "super", 0, f"{B}p min 2 {B}X{i}") for i in range(5)] + [(B + "D", "equiv", 0, f"{B}A and {B}q some {B}X"), (B + "A", "super", 0, f"{B}q some {B}X"), (B + "A", "super", 1, f"{B}r some {B}X")])
    forms = lambda n: {f: sorted(map(tuple, getattr(n, f).collect())) for f in n.__dataclass_fields__}
    want, hinted = forms(reasoning.normalise(x)), []
    real = reasoning.side
    monkeypatch.setattr(reasoning, "side", lambda d, *a: hinted.append(d.columns) or real(d, *a))
    monkeypatch.setattr(tables, "SENT", 0)
    assert forms(reasoning.normalise(x)) == want and len(hinted) > 6
    assert len(want["unsupported"]) == 5 and len(want["linked"]) == 1 and len(want["both"]) == 1

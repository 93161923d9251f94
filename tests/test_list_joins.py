"""Lists are walked without sending their cells through the driver."""

from test_operators import B

from termweave.sources import scans


def test_cells_are_not_broadcast(spark, monkeypatch):
    plans, save = [], scans.save
    monkeypatch.setattr(scans, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    n = 40
    first = spark.createDataFrame([(f"n{i}", f"{B}{i}") for i in range(n)], "node string, item string")
    rest = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % n}") for i in range(n)], "node string, next string")
    heads = spark.createDataFrame([(B + "head", "n0")], "head string, node string")
    out = scans.rdf_lists(first, rest, heads)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["pos"], r["item"]) for r in out.collect()) == [(i, f"{B}{i}") for i in range(n)]
    assert not any("BroadcastExchange" in p for p in plans)

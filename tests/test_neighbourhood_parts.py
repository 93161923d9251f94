"""The edges of a graph are dealt by their number and come once."""

from test_operators import B, onto

from termweave.operators import neighbourhood as N
from termweave.plans import tables


def test_edges_of_a_hub_are_dealt_and_come_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 50)
    up = [(f"{B}c{i}", B + "hub", "sub", 0) for i in range(300)] + [(B + "c0", B + "c1", "sub", 0)]
    x = onto(spark, class_edge=up)
    foci = spark.createDataFrame([("o", B + "hub")], "onto_id string, focus string")
    labels = spark.createDataFrame([], "onto_id string, iri string, label string")
    dealt = []
    monkeypatch.setattr(N, "spread", lambda df, rows, *keys: dealt.append((rows, keys)) or tables.spread(df, rows, *keys))
    edges = N.graph(foci, x, labels, 1, 1000)[1]
    ids = [r["id"] for r in edges.collect()]
    assert len(ids) == len(set(ids)) == 301 and dealt == [(600, ("onto_id", "focus", "source"))]

"""Restrictions that Spark takes apart, and rules that nothing new meets."""

from test_operators import B, onto

from pyspark.sql import functions as F

from termweave.functions.classexpr import flatten
from termweave.operators import reasoning
from termweave.plans import tables


def test_plain_restrictions_are_what_the_reader_reads(spark):
    exprs = ["p some A", f"{B}p some {B}x#A", "not some A", "NOT some A", "p some not", "some some some", "p some A and B", "p some 'A'", "<p> some A", "p  some A", "p some A ", "p SOME A", "p only A", "p some (q some A)", "p some é", "p some A\n", "A", "p some", "p some  A"]
    d = spark.createDataFrame([(e,) for e in exprs], "expr string")
    r, b = (F.regexp_extract("expr", reasoning.PLAIN, i) for i in (1, 2))
    plain = {r_["expr"]: (r_["r"], r_["b"]) for r_ in d.where(F.col("expr").rlike(reasoning.PLAIN)).select("expr", r.alias("r"), b.alias("b")).collect()}
    assert set(plain) == {"p some A", f"{B}p some {B}x#A", "some some some"}
    nodes = {(n["expr"], n["node_id"]): n for n in flatten(d).collect()}
    for e, (role, filler) in plain.items():
        top, kid = nodes[e, 0], nodes[e, 1]
        assert (top["op"], top["prop"], top["text"], kid["op"], kid["iri"], (e, 2) in nodes) == ("some", role, e, "class", filler, False)


def test_plain_restrictions_go_past_python(spark, monkeypatch):
    """Those that stand on a left side somewhere keep their names; the same restriction in two spellings is one link."""
    seen = []
    whole = reasoning.flatten
    monkeypatch.setattr(reasoning, "flatten", lambda d: seen.extend(r["expr"] for r in d.select("expr").collect()) or whole(d))
    x = onto(spark, entity=[(B + c, "class") for c in "ACDX"], class_expr=[(B + "A", "super", 0, f"{B}p some {B}X"), (B + "A", "super", 1, f"<{B}p> some {B}X"), (B + "A", "super", 2, f"{B}q some {B}X"), (B + "D", "equiv", 0, f"{B}q some {B}X"), (B + "C", "super", 0, f"{B}r some {B}X")])
    n = reasoning.normalise(x)
    assert sorted(map(tuple, n.linked.select("a", "r", "b").collect())) == [(B + "A", B + "p", B + "X"), (B + "C", B + "r", B + "X")]
    assert {r["r"] for r in n.some_right.collect()} == {B + c for c in "pqr"} and {r["r"] for r in n.some_left.collect()} == {B + "q"}
    assert set(seen) == {f"<{B}p> some {B}X", f"{B}q some {B}X"}
    facts = {(r["p"], r["x"], r["y"]) for r in reasoning.saturate(n).collect()}
    assert ("sub", B + "A", B + "D") in facts and ("sub", B + "C", B + "D") not in facts


def test_few_known_rows_are_compared_by_broadcast(spark):
    known = tables.save(spark.createDataFrame([("a", "x"), ("b", "y")], "k string, n string"))
    made = lambda rows: spark.createDataFrame(rows, "k string, n string")
    assert tables.unknown(made([("a", "x"), ("c", "x"), ("c", "x")]), known, ["k", "n"], ["n"]).collect() == [("c", "x")]
    assert tables.unknown(made([("a", "z"), ("a", "z")]), known, ["k", "n"], ["n"]).collect() == [("a", "z")]

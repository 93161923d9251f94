"""Kinds of subjects are gathered without sorting all triples."""

from termweave.model import OWL, RDFS, TYPE
from termweave.sources import scans

B = "http://b.example/"


def test_kinds_are_gathered_by_hash(spark):
    said = [("a", OWL + "Class"), ("a", B + "X"), ("b", B + "X"), ("p", OWL + "TransitiveProperty"), ("d", OWL + "DatatypeProperty"), ("d", OWL + "FunctionalProperty"), ("o", OWL + "Ontology"), ("o", OWL + "Class"), ("c", RDFS + "Class"), ("n", RDFS + "Literal")]
    t = spark.createDataFrame([("o", B + s, TYPE, k) for s, k in said], "onto_id string, s string, p string, o string")
    e = scans.entities_from_triples(t)
    assert {(r["iri"][len(B) :], r["type"]) for r in e.collect()} == {("a", "class"), ("b", "individual"), ("p", "objectProperty"), ("d", "dataProperty"), ("c", "class")}
    assert "SortAggregate" not in e._jdf.queryExecution().executedPlan().toString()

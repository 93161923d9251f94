"""What a saturation keeps and leaves behind."""

import os
import time

from test_operators import B, onto

from termweave.model import NOTHING
from termweave.operators import reasoning
from termweave.plans import tables
from termweave.plans.tables import CLEANUP, save


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = list(spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    files = lambda: [f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    before, told = set(files()), spark.conf.get(CLEANUP, None)
    save(spark.range(10_000).selectExpr("id % 1000 AS k").groupBy("k").count())
    for _ in range(20):
        if set(files()) <= before:
            break
        time.sleep(0.5)
    assert set(files()) <= before and spark.conf.get(CLEANUP, None) == told


def test_only_what_stands_on_a_left_side_is_found(spark):
    """A below p some X is the link from A to X; the name of `q some X` is needed, as D is defined by it."""
    x = onto(spark, entity=[(B + c, "class") for c in "ADX"], class_expr=[(B + "A", "super", 0, f"{B}p some {B}X"), (B + "A", "super", 1, f"{B}q some {B}X"), (B + "D", "equiv", 0, f"{B}q some {B}X")])
    facts = {(r["p"], r["x"], r["y"]) for r in reasoning.saturate(reasoning.normalise(x)).collect()}
    assert {(B + "p", B + "A", B + "X"), (B + "q", B + "A", B + "X"), ("sub", B + "A", B + "D")} <= facts
    assert len({y for p, a, y in facts if p == "sub" and a == B + "A" and y.startswith("_:")}) == 1


def test_direct_superclasses_of_a_chain(spark):
    up = [(B + a, B + b, "sub", 0) for a, b in ("QA", "AB", "BC")]
    x = onto(spark, entity=[(B + c, "class") for c in "QABC"], class_edge=up)
    q = spark.createDataFrame([("o", "q", B + "Q")], "onto_id string, query_id string, expr string")
    got = {(r["category"], r["iri"]) for r in reasoning.dl_query(x, q).collect()}
    assert {i for c, i in got if c == "superClasses"} == {B + c for c in "ABC"}
    assert {i for c, i in got if c == "directSuperClasses"} == {B + "A"}


def test_told_facts_are_not_copied_and_inner_tables_go(spark):
    """A transitive role over a chain of links, the last of which ends in a class below owl:Nothing."""
    links = [(B + a, "super", 0, f"{B}p some {B}{b}") for a, b in ("AB", "BC", "CD", "DE")]
    x = onto(spark, entity=[(B + c, "class") for c in "ABCDE"], class_expr=links, class_edge=[(B + "E", NOTHING, "sub", 0)], prop_flag=[(B + "p", "transitive")])
    before = set(tables._made)
    facts = reasoning.saturate(reasoning.normalise(x))
    found = [(r["p"], r["x"], r["y"]) for r in facts.collect()]
    got = {f for f in found if f[1].startswith(B)}  # restrictions have names of their own
    assert {(B + "p", B + a, B + b) for i, a in enumerate("ABCDE") for b in "ABCDE"[i + 1 :]} == {f for f in got if f[0] == B + "p"}
    assert {a for p, a, y in got if y == NOTHING} == {B + c for c in "ABCDE"} and len(found) == len(set(found))
    kind = lambda path: path.rstrip("/").split("/")[-1].rsplit("-", 1)[0]
    assert {"nf_sub", "nf_linked"} <= {kind(f.rsplit("/", 1)[0]) for f in facts.inputFiles()}
    assert not {kind(p) for p in set(tables._made) - before} & {"exprs", "nodes", "derived"}

"""Kept versions: digests tell the same as whole comparisons, and what is equal is not read."""

import os
import random

import pytest

from termweave.model import BASE as B
from termweave.model import SCHEMAS, Ontology
from termweave.operators import stored as K
from termweave.operators import versions as V

LINES = "path string, line_no long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def edits(seed, n=40):
    """Old and new lines of n files: few words, so lines repeat; heads, empty files, files of one side only."""
    r = random.Random(seed)
    old, new = [], []
    for p in range(n):
        a = [r.choice(["a", "b", "Prefix(x", "longer line of words"]) for _ in range(r.choice([0, 1, 7, 8, 9, 30]))]
        at, gone = r.randint(0, len(a)), r.choice([0, 0, 1, 3, 40])
        b = a[:at] + [r.choice("abz") for _ in range(r.choice([0, 0, 1, 2, 9]))] + a[at + gone:]
        old += [(f"f{p}", i, t) for i, t in enumerate(a)]
        new += [(f"f{p}", i, t) for i, t in enumerate(b)]
    return old, new


@pytest.mark.parametrize("block", [1, 4])
def test_kept_lines_compare_as_whole_files(spark, tmp_path, block):
    old, new = (spark.createDataFrame(d, LINES) for d in edits(block))
    a, b = (K.write_lines(d, K.StoredLines(spark, f"file://{tmp_path}/{n}", 4, block)) for n, d in (("a", old), ("b", new)))
    whole = V.changed_region(old, new)
    assert rows(K.changed_region(a, b)) == rows(whole)
    for ratio, floor in ((0.2, 3), (0.5, 20), (0.0, 0)):
        assert rows(K.incremental_safe(a, b, whole, ratio, floor)) == rows(V.incremental_safe(old, new, whole, ratio, floor))


def test_equal_files_are_not_read(spark, tmp_path):
    lines = [(f"f{p}", i, f"line {i}") for p in range(3) for i in range(50)]
    a, b = (K.write_lines(spark.createDataFrame(lines, LINES), K.StoredLines(spark, f"file://{tmp_path}/{n}", 4, 8)) for n in "ab")
    for n in "ab":
        os.rename(tmp_path / n / "lines", tmp_path / n / "elsewhere")
    got = K.changed_region(a, b)
    assert [tuple(r)[1:] for r in got.collect()] == [(True, 0, 0, 0)] * 3
    assert all(r["safe"] for r in K.incremental_safe(a, b, got).collect())


def test_only_blocks_at_the_ends_of_a_change_are_read(spark, tmp_path):
    old = [("f", i, f"line {i}") for i in range(1000)]
    new = [(p, i, t if i not in (300, 700) else "x") for p, i, t in old]
    a, b = (K.write_lines(spark.createDataFrame(d, LINES), K.StoredLines(spark, f"file://{tmp_path}/{n}", 64, 10)) for n, d in (("a", old), ("b", new)))
    asked = []
    lines = K.StoredLines.lines
    K.StoredLines.lines = lambda self, wanted: asked.append(d := lines(self, wanted)) or d
    try:
        assert tuple(K.changed_region(a, b).first())[1:] == (False, 300, 701, 701)
    finally:
        K.StoredLines.lines = lines
    assert [d.count() for d in asked] == [20, 20]


def test_blocks_of_other_sizes_do_not_compare(spark, tmp_path):
    with pytest.raises(ValueError):
        K.changed_region(K.StoredLines(spark, "a", block=2), K.StoredLines(spark, "b", block=3))


def onto(spark, labels, edges, kinds=()):
    """labels and edges {name: ...} of classes; every name is an entity."""
    names = {*labels, *edges, *kinds}
    data = {
        "entity": [("o", B + n, "class") for n in names],
        "label": [("o", B + n, "en", 0, t) for n, t in labels.items()],
        "class_edge": [("o", B + n, B + s, "sub", 0) for n, sups in edges.items() for s in sups],
    }
    return Ontology(**{n: spark.createDataFrame(data.get(n, []), SCHEMAS[n]) for n in SCHEMAS})


def told(x):
    return {n: rows(d) for n, d in V.tables(x).items()}


def test_versions_share_what_did_not_change(spark, tmp_path):
    labels, edges = {f"c{i}": f"label {i}" for i in range(40)}, {f"c{i}": [f"c{i // 2}"] for i in range(1, 40)}
    x0 = onto(spark, labels, edges)
    v0 = K.write(x0, K.StoredOntology(spark, f"file://{tmp_path}/store", 16))
    assert told(v0.ontology()) == told(x0)
    # c1 is relabelled, c2 moved, c3 lost, new one comes
    l1 = {k: v for k, v in labels.items() if k != "c3"} | {"c1": "other", "new": "new one"}
    e1 = {k: v for k, v in edges.items() if k != "c3"} | {"c2": ["c0", "c5"]}
    x1 = onto(spark, l1, e1)
    touched = V.changed_entities(x0, x1)
    v1 = K.merge(v0, x1, touched.select("onto_id", "iri"))
    assert told(v1.ontology()) == told(x1) and told(v0.ontology()) == told(x0)
    assert rows(K.changed_entities(v0, v1)) == rows(touched) != []
    changed = [p for p, at in v1.where().items() if at == 1]
    assert 0 < len(changed) <= 4 and {*v0.where().values()} == {0}
    # a second change upon the first; a version written anew has the same digests
    x2 = onto(spark, l1 | {"c7": "seven"}, e1)
    v2 = K.merge(v1, x2, spark.createDataFrame([("o", B + "c7")], "onto_id string, iri string"))
    again = K.write(x2, K.StoredOntology(spark, f"file://{tmp_path}/again", 16))
    assert rows(K.changed_entities(v2, again)) == []
    assert rows(K.changed_entities(v0, v2)) == rows(V.changed_entities(x0, x2))


def test_unchanged_ontologies_cost_no_reading_of_tables(spark, tmp_path):
    x = onto(spark, {"a": "a", "b": "b"}, {"a": ["b"]})
    v = K.write(x, K.StoredOntology(spark, f"file://{tmp_path}/one", 4))
    w = K.write(x, K.StoredOntology(spark, f"file://{tmp_path}/two", 4))
    assert K.merge(v, x, spark.createDataFrame([], "onto_id string, iri string")) is v
    for n in (*SCHEMAS, "digests"):
        os.rename(tmp_path / "one" / n, tmp_path / "one" / f"hidden {n}")
    assert rows(K.changed_entities(v, w)) == []
    with pytest.raises(ValueError):
        K.changed_entities(v, K.StoredOntology(spark, v.path, 8))


def test_a_version_cut_short_is_written_again(spark, tmp_path):
    x, y = onto(spark, {"a": "a", "b": "b"}, {}), onto(spark, {"a": "z", "b": "b"}, {})
    v = K.write(x, K.StoredOntology(spark, f"file://{tmp_path}/store", 4))
    t = spark.createDataFrame([("o", B + "a")], "onto_id string, iri string")
    finish, K.StoredOntology.finish = K.StoredOntology.finish, lambda self, where: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            K.merge(v, y, t)
    finally:
        K.StoredOntology.finish = finish
    assert told(v.ontology()) == told(x)
    assert told(K.merge(v, y, t).ontology()) == told(y)


def test_empty_versions(spark, tmp_path):
    none = spark.createDataFrame([], LINES)
    a, b = (K.write_lines(none, K.StoredLines(spark, f"file://{tmp_path}/{n}", 4)) for n in "ab")
    assert rows(K.changed_region(a, b)) == []
    v = K.write(onto(spark, {}, {}), K.StoredOntology(spark, f"file://{tmp_path}/store", 4))
    w = K.write(onto(spark, {"a": "a"}, {}), K.StoredOntology(spark, f"file://{tmp_path}/other", 4))
    assert [r["iri"] for r in K.changed_entities(v, w).collect()] == [B + "a"]

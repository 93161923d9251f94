"""Versions (V) over customers: in the second version keys ending in 0 are gone, in 1 relabelled, in 2 moved."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.catalogs.graph import CUSTOMER, onto
from termweave.model import BASE, Ontology, local_name, table
from termweave.operators import stored as K
from termweave.operators import versions as V
from termweave.plans.tables import shared_path

B = BASE


def key(c: str = "iri"):
    return local_name(F.col(c)).try_cast("long")


def customers_only(x: Ontology) -> Ontology:
    own = lambda d, c: d.where(F.col(c).contains("/customer/"))
    return Ontology(**{n: own(d, V.OWNER[n]) for n, d in V.tables(x).items()})


def versions(spark, sf_dir) -> tuple[Ontology, Ontology]:
    old = customers_only(onto(spark, sf_dir))
    kept = {n: d.where(key(V.OWNER[n]) % 10 != 0) for n, d in V.tables(old).items()}
    new = Ontology(**kept)
    label = new.label.withColumn("text", F.when(key() % 10 == 1, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    moved = new.class_edge.where(key("sub") % 10 == 2).withColumn("sup", F.lit(B + "region/0"))
    return old, replace(new, label=label, class_edge=new.class_edge.unionByName(moved))


@query("v01_axiom_diff", f"SELECT {CUSTOMER} AS iri, 'SubClassOf nation/' || c_nationkey AS line, 'remove' AS action, CASE c_custkey % 10 WHEN 0 THEN 1 WHEN 3 THEN 2 END AS n FROM customer WHERE c_custkey % 10 IN (0, 3) UNION ALL SELECT {CUSTOMER}, 'SubClassOf region/0', 'add', 1 FROM customer WHERE c_custkey % 10 = 2")
def v01(spark, sf_dir):
    """Keys ending in 3 have their line three times in the file; the model is a set."""
    old, new = versions(spark, sf_dir)
    line = lambda d: d.select(F.col("sub").alias("iri"), F.concat(F.lit("SubClassOf "), F.regexp_replace("sup", "^" + B, "")).alias("line"))
    file = line(old.class_edge)
    again = file.where(key() % 10 == 3)
    return V.axiom_diff(file.unionByName(again).unionByName(again), line(new.class_edge).unionByName(line(new.class_edge)))


@query("v02_annotation_diff", f"SELECT {CUSTOMER} AS iri, 'label' AS prop, c_name AS text, 'en' AS lang, 'remove' AS action FROM customer WHERE c_custkey % 10 IN (0, 1) UNION ALL SELECT {CUSTOMER}, 'label', c_name || ' new', 'en', 'add' FROM customer WHERE c_custkey % 10 = 1")
def v02(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    ann = lambda x: x.label.select("iri", F.lit("label").alias("prop"), "text", "lang")
    return V.annotation_diff(ann(old), ann(new))


def documents(spark, sf_dir):
    """Old and new lines of a file for each nation: its customers by key; the new one by the second version."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"), "c_custkey", "c_name")
    w = W.partitionBy("path").orderBy("c_custkey")
    number = lambda d: d.select("path", (F.row_number().over(w) - 1).cast("long").alias("line_no"), F.col("t").alias("text"), "c_custkey")
    old = number(c.withColumn("t", F.col("c_name")))
    new = number(c.where("c_custkey % 10 <> 0").withColumn("t", F.when(F.col("c_custkey") % 10 == 1, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name"))))
    return old, new


LINE_SQL = """
WITH o AS (SELECT c_nationkey AS path, c_custkey AS k, c_name AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer),
m AS (SELECT c_nationkey AS path, c_custkey AS k, CASE WHEN c_custkey % 10 = 1 THEN c_name || ' new' ELSE c_name END AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer WHERE c_custkey % 10 <> 0),
s AS (SELECT path, max(c) AS c FROM o GROUP BY 1), u AS (SELECT path, max(c) AS c FROM m GROUP BY 1),
f AS (SELECT s.path, s.c AS co, coalesce(u.c, 0) AS cm, (SELECT min(o.n) FROM o JOIN m ON o.path = m.path AND o.n = m.n WHERE o.path = s.path AND o.t <> m.t) AS first, (SELECT min(o.c - o.n - 1) FROM o JOIN m ON o.path = m.path AND o.c - o.n = m.c - m.n WHERE o.path = s.path AND o.t <> m.t) AS back FROM s LEFT JOIN u ON u.path = s.path),
g AS (SELECT path, co, cm, co = cm AND first IS NULL AS identical, coalesce(first, least(co, cm)) AS st, least(coalesce(back, least(co, cm)), least(co, cm) - coalesce(first, least(co, cm))) AS tail FROM f),
r AS (SELECT path, identical, CASE WHEN identical THEN 0 ELSE st END AS start_line, CASE WHEN identical THEN 0 ELSE co - tail END AS old_end, CASE WHEN identical THEN 0 ELSE cm - tail END AS new_end FROM g)
"""


@query("v03_changed_region", LINE_SQL + "SELECT * FROM r")
def v03(spark, sf_dir):
    old, new = documents(spark, sf_dir)
    return V.changed_region(old, new)


def kept_lines(spark, sf_dir) -> tuple[K.StoredLines, K.StoredLines]:
    return tuple(K.write_lines(d, K.StoredLines(spark, shared_path(spark, "lines"))) for d in documents(spark, sf_dir))


@query("v03_stored_region", LINE_SQL + "SELECT * FROM r")
def v03_stored(spark, sf_dir):
    """Both versions are kept in blocks of lines; blocks that agree by digest are not read."""
    return K.changed_region(*kept_lines(spark, sf_dir))


CHANGED_SQL = f"SELECT {CUSTOMER} AS iri, c_custkey % 10 IN (0, 2) AS logical, c_custkey % 10 IN (0, 1) AS textual FROM customer WHERE c_custkey % 10 IN (0, 1, 2)"


@query("v04_stored_entities", CHANGED_SQL)
def v04_stored(spark, sf_dir):
    """Both versions are kept apart; their folders, then entities are compared by digest."""
    old, new = (K.write(x, K.StoredOntology(spark, shared_path(spark, "version"))) for x in versions(spark, sf_dir))
    return K.changed_entities(old, new).drop("onto_id")


@query("v04_changed_entities", CHANGED_SQL)
def v04(spark, sf_dir):
    return V.changed_entities(*versions(spark, sf_dir)).drop("onto_id")


SAFE_SQL = LINE_SQL + ", z AS (SELECT r.path, identical, (SELECT coalesce(sum(length(t) + 1), 0) FROM o WHERE o.path = r.path AND n >= start_line AND n < old_end) AS a, (SELECT sum(length(t) + 1) FROM o WHERE o.path = r.path) AS aa, (SELECT coalesce(sum(length(t) + 1), 0) FROM m WHERE m.path = r.path AND n >= start_line AND n < new_end) AS b, (SELECT coalesce(sum(length(t) + 1), 1) FROM m WHERE m.path = r.path) AS bb FROM r) SELECT path, identical OR NOT ((a > 50 AND a / aa > 0.9) OR (b > 50 AND b / bb > 0.9)) AS safe FROM z"


@query("v05_incremental_safe", SAFE_SQL)
def v05(spark, sf_dir):
    old, new = documents(spark, sf_dir)
    return V.incremental_safe(old, new, V.changed_region(old, new), 0.9, 50)


@query("v05_stored_safe", SAFE_SQL)
def v05_stored(spark, sf_dir):
    old, new = kept_lines(spark, sf_dir)
    return K.incremental_safe(old, new, K.changed_region(old, new), 0.9, 50)


@query("v06_affected_entities", LINE_SQL + f"SELECT r.path, '{B}customer/' || k AS iri FROM r JOIN o ON o.path = r.path AND NOT identical AND n >= start_line AND n < old_end")
def v06(spark, sf_dir):
    old, new = documents(spark, sf_dir)
    owners = old.select("path", "line_no", F.concat(F.lit(B + "customer/"), F.col("c_custkey").cast("string")).alias("iri"))
    return V.affected(owners, V.changed_region(old, new), "old_end")


MERGED_SQL = f"SELECT {CUSTOMER} AS iri, CASE WHEN c_custkey % 10 = 1 THEN c_name || ' new' ELSE c_name END AS label, CASE WHEN c_custkey % 10 = 2 THEN 2 ELSE 1 END AS edges FROM customer WHERE c_custkey % 10 <> 0"


def merged(m: Ontology):
    edges = m.class_edge.groupBy(F.col("sub").alias("iri")).agg(F.count("*").alias("edges"))
    return m.entity.select("iri").join(m.label.select("iri", F.col("text").alias("label")), "iri").join(edges, "iri")


@query("v07_merge", MERGED_SQL)
def v07(spark, sf_dir):
    """The changed entities of the second version merged into the first give the second."""
    old, new = versions(spark, sf_dir)
    return merged(V.merge(old, new, V.changed_entities(old, new).select("onto_id", "iri")))


@query("v07_stored_merge", MERGED_SQL)
def v07_stored(spark, sf_dir):
    """As v07_merge, on a kept version; the next one shares the folders of untouched entities."""
    old, new = versions(spark, sf_dir)
    first = K.write(old, K.StoredOntology(spark, shared_path(spark, "version")))
    return merged(K.merge(first, new, V.changed_entities(old, new).select("onto_id", "iri")).ontology())


@query("v10_rename", f"SELECT CASE WHEN c_custkey % 10 = 1 THEN '{B}renamed/' || c_custkey ELSE {CUSTOMER} END AS iri, c_name AS label, 'p some ' || CASE WHEN c_custkey % 10 = 1 THEN '{B}renamed/' || c_custkey ELSE {CUSTOMER} END || ' and (x)' AS expr FROM customer")
def v10(spark, sf_dir):
    """Keys ending in 1 are renamed, in labels and inside expressions; targets that exist are rejected."""
    x = customers_only(onto(spark, sf_dir))
    x = replace(x, class_expr=x.entity.select("onto_id", "iri", F.lit("super").alias("role"), F.lit(0).alias("ord"), F.concat(F.lit("p some "), "iri", F.lit(" and (x)")).alias("expr")))
    ok = x.entity.where(key() % 10 == 1).select(F.col("iri").alias("old"), F.regexp_replace("iri", "/customer/", "/renamed/").alias("new"))
    taken = x.entity.where(key() % 10 == 2).select(F.col("iri").alias("old"), F.concat(F.lit(B + "customer/"), (key() + 1).cast("string")).alias("new"))
    y, _ = V.rename(x, ok.unionByName(taken.join(x.entity.select(F.col("iri").alias("new")), "new", "left_semi").select("old", "new")))
    return y.label.select("iri", F.col("text").alias("label")).join(y.class_expr.select("iri", "expr"), "iri")


@query("v11_create", f"SELECT '{B}customer/' || (c_custkey * 2) AS iri, CASE WHEN c_custkey * 2 IN (SELECT c_custkey FROM customer) THEN 'exists' ELSE 'new' END AS outcome FROM customer")
def v11(spark, sf_dir):
    x = customers_only(onto(spark, sf_dir))
    c = table(spark, sf_dir, "customer")
    wanted = c.select(F.lit("shop").alias("onto_id"), F.lit(B + "customer/").alias("namespace"), (F.col("c_custkey") * 2).cast("string").alias("local"), F.lit("class").alias("type"), F.lit(B + "nation/0").alias("parent"))
    y, bad = V.create(x, wanted)
    new = y.entity.join(x.entity, ["onto_id", "iri"], "left_anti").select("iri", F.lit("new").alias("outcome"))
    return new.unionByName(bad.select(F.concat("namespace", "local").alias("iri"), F.col("reason").alias("outcome")))


@query("v12_unchanged_skip", "SELECT c_custkey AS path FROM customer WHERE c_custkey % 4 > 1")
def v12(spark, sf_dir):
    """A file for each customer; a quarter with another size, a quarter with another time."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") * 7).alias("mtime_ms"), F.length("c_name").cast("long").alias("size"))
    k = F.col("path") % 4
    known = c.select("path", F.when(k == 2, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return V.unchanged_skipped(c, known).select("path")


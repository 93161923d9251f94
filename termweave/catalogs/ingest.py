"""Scans (S), sinks (K), source lines (A03) and ingest errors (D06): tables written as text and read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.catalogs.graph import CUSTOMER, NATION, onto, triples
from termweave.catalogs.lifecycle import customers_only, key
from termweave.functions import expressions as E
from termweave.model import BASE, LABEL, OWL, SKOS, table
from termweave.plans.tables import shared_path
from termweave.sources import scans as S
from termweave.sources import sinks as K

B = BASE
NL = "chr(10)"


def shop(spark, sf_dir):
    """Customers and nations with their labels, edges, annotations and data; every tenth label holds a line feed, quotes and a backslash."""
    x = onto(spark, sf_dir)
    own = lambda d, c: d.where(F.col(c).contains("/customer/") | F.col(c).contains("/nation/"))
    odd = F.when(F.col("iri").contains("/customer/") & (key() % 10 == 0), F.concat("text", F.lit('\nsays "a > b" \\'))).otherwise(F.col("text"))
    none = {n: getattr(x, n).where("false") for n in ("prop_edge", "prop_flag", "prop_chain", "type_assert", "obj_assert", "class_expr")}
    props = x.entity.where("type like '%Property'")
    return replace(x, entity=own(x.entity, "iri").unionByName(props), label=own(x.label, "iri").withColumn("text", odd), annotation=own(x.annotation, "iri"), class_edge=own(x.class_edge, "sub"), data_assert=own(x.data_assert, "ind"), **none)


def written(spark, sf_dir):
    """The shop as functional text in the shared folder, read back as lines."""
    path = shared_path(spark, "functional")
    K.write_functional(shop(spark, sf_dir), B, path)
    return S.lines(spark, path, document=True)


def axioms(spark, sf_dir):
    return S.functional(S.joined_lines(written(spark, sf_dir)))


ODD = f"CASE WHEN c_custkey % 10 = 0 THEN c_name || {NL} || 'says \"a > b\" \\' ELSE c_name END"


@query("s01_functional_scan", f"SELECT 'SubClassOf' AS keyword, '<' || {CUSTOMER} || '> <{B}nation/' || c_nationkey || '>' AS args FROM customer UNION ALL SELECT 'SubClassOf', '<' || {NATION} || '> <{B}region/' || n_regionkey || '>' FROM nation UNION ALL SELECT 'Declaration', 'Class(<' || {CUSTOMER} || '>)' FROM customer UNION ALL SELECT 'Declaration', 'Class(<' || {NATION} || '>)' FROM nation UNION ALL SELECT 'AnnotationAssertion', 'rdfs:label <' || {CUSTOMER} || '> \"' || replace(replace({ODD}, '\\', '\\\\'), '\"', '\\\"') || '\"@en' FROM customer UNION ALL SELECT 'AnnotationAssertion', '<{B}segment> <' || {CUSTOMER} || '> \"' || c_mktsegment || '\"@en' FROM customer")
def s01(spark, sf_dir):
    a = axioms(spark, sf_dir)
    return a.where("keyword in ('SubClassOf', 'Declaration') and args not like '%Property%' or keyword = 'AnnotationAssertion' and args like '%/customer/%'").select("keyword", "args")


def mixed(spark, sf_dir):
    """SubClassOf axioms of all four routes, by customer key."""
    c = table(spark, sf_dir, "customer")
    k, a, b = F.col("c_custkey") % 4, F.concat(F.lit(f"<{B}customer/"), F.col("c_custkey").cast("string"), F.lit(">")), F.concat(F.lit(f"<{B}nation/"), F.col("c_nationkey").cast("string"), F.lit(">"))
    some = lambda n: F.concat(F.lit(f"ObjectSomeValuesFrom(<{B}hasPart> "), n, F.lit(")"))
    args = F.when(k == 0, F.concat_ws(" ", a, b)).when(k == 1, F.concat_ws(" ", a, some(b))).when(k == 2, F.concat_ws(" ", some(a), b)).otherwise(F.concat_ws(" ", some(a), some(b)))
    return c.select(F.lit("f").alias("path"), F.col("c_custkey").alias("line_no"), F.lit(0).cast("long").alias("char_start"), F.lit("SubClassOf").alias("keyword"), args.alias("args"))


SOME = f"'ObjectSomeValuesFrom(<{B}hasPart> <'"


@query("s02_subclass_routes", f"SELECT c_custkey AS line_no, CASE c_custkey % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'super' WHEN 2 THEN 'gci' ELSE 'standalone' END AS route, CASE c_custkey % 4 WHEN 2 THEN '{B}nation/' || c_nationkey WHEN 3 THEN NULL ELSE {CUSTOMER} END AS iri, CASE c_custkey % 4 WHEN 0 THEN '{B}nation/' || c_nationkey WHEN 1 THEN {SOME} || '{B}nation/' || c_nationkey || '>)' WHEN 2 THEN {SOME} || {CUSTOMER} || '>)' ELSE 'SubClassOf(' || {SOME} || {CUSTOMER} || '>) ' || {SOME} || '{B}nation/' || c_nationkey || '>))' END AS other FROM customer")
def s02(spark, sf_dir):
    return S.subclass_routes(mixed(spark, sf_dir)).drop("path")


@query("s02_class_pairs", f"SELECT '{B}nation/' || a.n_nationkey AS sub, '{B}nation/' || b.n_nationkey AS sup, 'equiv' AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey UNION ALL SELECT '{B}nation/' || a.n_nationkey, '{B}nation/' || b.n_nationkey, 'disjoint' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey UNION ALL SELECT '{B}region/' || n_regionkey, {NATION}, 'disjoint' FROM nation")
def s02_pairs(spark, sf_dir):
    """One axiom of each kind for every region: its nations equivalent, disjoint, and a disjoint union."""
    n = table(spark, sf_dir, "nation")
    own = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(f"<{B}nation/"), F.col("n_nationkey").cast("string"), F.lit(">")))), " ").alias("o"))
    union = F.concat(F.lit(f"<{B}region/"), F.col("n_regionkey").cast("string"), F.lit("> "), "o")
    kinds = F.array(F.struct(F.lit("EquivalentClasses").alias("k"), F.col("o").alias("a")), F.struct(F.lit("DisjointClasses").alias("k"), F.col("o").alias("a")), F.struct(F.lit("DisjointUnion").alias("k"), union.alias("a")))
    return S.class_pairs(own.select(F.explode(kinds).alias("x")).select(F.col("x.k").alias("keyword"), F.col("x.a").alias("args")))


@query("s02_inverse_pairs", f"SELECT '{B}p' || c_custkey AS prop, '{B}q' || c_custkey AS target FROM customer UNION ALL SELECT '{B}q' || c_custkey, '{B}p' || c_custkey FROM customer")
def s02_inverse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("InverseObjectProperties").alias("keyword"), F.concat(F.lit(f"<{B}p"), F.col("c_custkey").cast("string"), F.lit(f"> <{B}q"), F.col("c_custkey").cast("string"), F.lit(">")).alias("args"))
    return S.inverse_pairs(c)


@query("s03_annotations", f"SELECT {CUSTOMER} AS iri, '{LABEL}' AS prop, {ODD} AS text, 'en' AS lang, true AS is_label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT {CUSTOMER}, '{B}segment', c_mktsegment, 'en', false FROM customer WHERE c_custkey % 2 = 0")
def s03(spark, sf_dir):
    """Customers with odd keys count as undeclared, so their annotations go."""
    a = axioms(spark, sf_dir)
    known = S.declarations(a).where(key() % 2 == 0).where("iri like '%/customer/%'")
    return S.annotations(a, known).select("iri", "prop", "text", "lang", "is_label")


def documents_of(rows, root: str, name: str, attributes: str = ""):
    """A document for each n, of bounded size: its elements (n, value) under one root element."""
    path = shared_path(rows.sparkSession, name)
    whole = rows.groupBy("n").agg(F.concat(F.lit(f"<{root}{attributes}>"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"</{root}>")).alias("value"))
    whole.write.partitionBy("n").text(path)
    return path


def block(size: int = 10_000):
    """A nation's customers of one range of keys, whatever the number of customers."""
    return F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / size).cast("string"))


def rows_as_text(df, name: str):
    path = shared_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("s04_rdfxml", f"SELECT {CUSTOMER} AS iri, 'label' AS relation, c_name AS value, 'en' AS lang FROM customer UNION ALL SELECT {CUSTOMER}, 'super', '{B}nation/' || c_nationkey, '' FROM customer UNION ALL SELECT {CUSTOMER}, 'expr', '{B}hasPart some {B}region/' || c_custkey % 5, '' FROM customer")
def s04(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    x = F.concat(F.lit(f'<owl:Class rdf:about="{B}customer/'), k, F.lit('"><rdfs:label xml:lang="en">'), "c_name", F.lit(f'</rdfs:label><rdfs:subClassOf rdf:resource="{B}nation/'), n, F.lit(f'"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="{B}hasPart"/><owl:someValuesFrom rdf:resource="{B}region/'), (F.col("c_custkey") % 5).cast("string"), F.lit('"/></owl:Restriction></rdfs:subClassOf></owl:Class>'))
    return S.rdfxml_classes(spark, documents_of(c.select(block().alias("n"), x.alias("value")), "rdf:RDF", "rdfxml"), B)


@query("s05_owlxml", f"SELECT {CUSTOMER} AS sub, '{B}nation/' || c_nationkey AS sup FROM customer")
def s05(spark, sf_dir):
    """Named axioms, and for every customer one with a composite side, which is left out."""
    c = table(spark, sf_dir, "customer")
    one = lambda iri: F.concat(F.lit('<Class IRI="'), iri, F.lit('"/>'))
    a, b = F.concat(F.lit(B + "customer/"), F.col("c_custkey").cast("string")), F.concat(F.lit(B + "nation/"), F.col("c_nationkey").cast("string"))
    x = F.concat(F.lit("<SubClassOf>"), one(a), one(b), F.lit("</SubClassOf>"))
    y = F.concat(F.lit("<SubClassOf>"), one(a), F.lit('<ObjectSomeValuesFrom><ObjectProperty IRI="p"/></ObjectSomeValuesFrom></SubClassOf>'))
    return S.owlxml_subclasses(spark, documents_of(c.select(block().alias("n"), F.explode(F.array(x, y)).alias("value")), "Ontology", "owlxml"))


@query("s06_manchester", f"SELECT {CUSTOMER} AS frame, 'SubClassOf' AS section, '<{B}nation/' || c_nationkey || '>' AS item FROM customer UNION ALL SELECT {CUSTOMER}, 'Annotations', 'rdfs:label \"' || c_name || '\"@en' FROM customer UNION ALL SELECT {NATION}, 'SubClassOf', '<{B}region/' || n_regionkey || '>' FROM nation UNION ALL SELECT {NATION}, 'Annotations', 'rdfs:label \"' || n_name || '\"@en' FROM nation UNION ALL SELECT {CUSTOMER}, 'Facts', '<{B}acctbal> \"' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>' FROM customer")
def s06(spark, sf_dir):
    """Frames written by K03 and read back."""
    x = shop(spark, sf_dir)
    y = replace(x, label=onto(spark, sf_dir).label.where("iri like '%/customer/%' or iri like '%/nation/%'"), annotation=x.annotation.where("false"))
    path = shared_path(spark, "manchester")
    K.write_manchester(y, path)
    return S.manchester(S.lines(spark, path)).where("section <> ''").select("frame", "section", "item")


@query("s07_triples_to_entities", f"SELECT {CUSTOMER} AS iri, 'class' AS type FROM customer UNION ALL SELECT '{B}part/' || p_partkey, 'individual' FROM part UNION ALL SELECT unnest(['{B}hasPart', '{B}partOf', '{B}madeOf']), 'objectProperty'")
def s07(spark, sf_dir):
    rows = S.entities_from_triples(triples(spark, sf_dir))
    return rows.where("iri like '%/customer/%' or iri like '%/part/%' or type = 'objectProperty'").select("iri", "type")


@query("s07_assertions", f"SELECT '{B}part/' || p_partkey AS ind, '{B}size' AS prop, CAST(p_size AS VARCHAR) AS value, 'data' AS kind FROM part")
def s07_assertions(spark, sf_dir):
    t = triples(spark, sf_dir)
    return S.assertions_from_triples(t, S.entities_from_triples(t)).drop("onto_id")


@query("s08_rdf_lists", f"SELECT '{B}nation/' || c_nationkey AS head, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, {CUSTOMER} AS item FROM customer")
def s08(spark, sf_dir):
    """The customers of each nation as an RDF list; every list ends in a cycle to its head."""
    c = table(spark, sf_dir, "customer")
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    node = lambda i: F.concat_ws("-", F.lit("n"), F.col("c_nationkey").cast("string"), i.cast("string"))
    i = F.row_number().over(w) - 1
    last = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.col("c_custkey").desc())) == 1
    cells = c.select("c_nationkey", "c_custkey", i.alias("i"), last.alias("last"))
    first = cells.select(node(F.col("i")).alias("node"), F.concat(F.lit(B + "customer/"), F.col("c_custkey").cast("string")).alias("item"))
    rest = cells.select(node(F.col("i")).alias("node"), node(F.when(F.col("last"), 0).otherwise(F.col("i") + 1)).alias("next"))
    heads = cells.where("i = 0").select(F.concat(F.lit(B + "nation/"), F.col("c_nationkey").cast("string")).alias("head"), node(F.col("i")).alias("node"))
    return S.rdf_lists(first, rest, heads)


HEADS = ['<?xml version="1.0"?><Ontology xmlns="x">', '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="x">', "# note\nPrefix(:=<x>)\nOntology(<x>", "﻿# note\nOntology: <x>", "# note\n@prefix : <x> .", "nothing"]
NAMES = ["owl-xml", "rdf-xml", "functional", "manchester", "turtle", "unknown"]


@query("s09_content_format", "SELECT doc_id, list_extract([" + ", ".join(f"'{n}'" for n in NAMES) + "], CAST(doc_id % 6 + 1 AS INTEGER)) AS format FROM documents")
def s09(spark, sf_dir):
    """Every document under the beginning of one of the formats."""
    d = table(spark, sf_dir, "documents")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", S.content_format(F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))).alias("format"))


@query("s10_path_format", "SELECT doc_id, list_extract(['functional', 'functional', 'manchester', 'turtle', 'rdf-xml', 'functional'], CAST(doc_id % 6 + 1 AS INTEGER)) AS format FROM documents")
def s10(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ["ofn", "OWF", "omn", "ttl", "rdf", "x"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.path_format(F.concat(F.lit("/a.b/"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("format"))


@query("s11_prefixes", f"SELECT 'n' || n_nationkey AS name, '{B}nation/' || n_nationkey || '/' AS expansion FROM nation UNION ALL SELECT '', 'http://d/' FROM (SELECT 1)")
def s11(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    own = n.select(F.concat(F.lit("Prefix(n"), F.col("n_nationkey").cast("string"), F.lit(f":=<{B}nation/"), F.col("n_nationkey").cast("string"), F.lit("/>)")).alias("value"))
    more = n.where("n_nationkey = 0").select(F.lit(" Prefix( := <http://d/> )").alias("value"))
    noise = n.select(F.concat(F.lit("# Prefix(x:=<y>) "), "n_name").alias("value"))
    return S.prefixes(S.lines(spark, rows_as_text(own.unionByName(more).unionByName(noise), "prefixes"))).select("name", "expansion")


@query("s12_sparql_results", f"SELECT c_nationkey AS path, c_custkey AS k, 'x' AS var, '<' || {CUSTOMER} || '>' AS term FROM customer UNION ALL SELECT c_nationkey, c_custkey, 'l', '\"' || c_name || '\"' || CASE c_custkey % 3 WHEN 0 THEN '@en' WHEN 1 THEN '^^<http://www.w3.org/2001/XMLSchema#token>' ELSE '' END FROM customer")
def s12(spark, sf_dir):
    """Results of bounded size, built as JSON from a nation's customers of one range of keys."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lit = F.struct(F.lit("literal").alias("type"), F.col("c_name").alias("value"), F.when(k % 3 == 0, "en").alias("xml:lang"), F.when(k % 3 == 1, "http://www.w3.org/2001/XMLSchema#token").when(k % 3 == 2, "http://www.w3.org/2001/XMLSchema#string").alias("datatype"))
    uri = F.struct(F.lit("uri").alias("type"), F.concat(F.lit(B + "customer/"), k.cast("string")).alias("value"))
    rows = c.groupBy(F.col("c_nationkey").alias("path"), block().alias("part")).agg(F.collect_list(F.struct(uri.alias("x"), lit.alias("l"))).alias("bindings"), F.array_sort(F.collect_list("c_custkey")).alias("ks"))
    j = rows.select("path", "part", F.to_json(F.struct(F.struct(F.array(F.lit("x"), F.lit("l")).alias("vars")).alias("head"), F.struct("bindings").alias("results"))).alias("json"))
    out = S.sparql_results(j)
    x = out.where("var = 'x'").select("part", "row_no", F.regexp_extract("term", r"(\d+)>$", 1).cast("long").alias("k"))
    return out.join(x, ["part", "row_no"]).select("path", "k", "var", "term")


# ---------------------------------------------------------------- sinks


@query("k01_functional_document", f"SELECT '3class' AS section, 'SubClassOf(<' || {CUSTOMER} || '> <{B}nation/' || c_nationkey || '>)' AS line FROM customer UNION ALL SELECT '1declaration', 'Declaration(Class(<' || {CUSTOMER} || '>))' FROM customer UNION ALL SELECT '2annotation', 'AnnotationAssertion(rdfs:label <' || {CUSTOMER} || '> \"' || c_name || '\"@en)' FROM customer UNION ALL SELECT '2annotation', 'AnnotationAssertion(<{B}segment> <' || {CUSTOMER} || '> \"' || c_mktsegment || '\"@en)' FROM customer UNION ALL SELECT '0head', 'Ontology(<{B}>' UNION ALL SELECT '9end', ')'")
def k01(spark, sf_dir):
    x = customers_only(onto(spark, sf_dir))
    d = K.functional_document(replace(x, data_assert=x.data_assert.where("false")), B)
    return d.where("section <> '0head' or line like 'Ontology%'").select("section", "line")


@query("k02_axiom_lines", f"SELECT '{B}part/' || p_partkey AS iri, 'ClassAssertion(<{B}ptype/' || p_type || '> <{B}part/' || p_partkey || '>)' AS line FROM part UNION ALL SELECT '{B}part/' || p_partkey, 'DataPropertyAssertion(<{B}size> <{B}part/' || p_partkey || '> \"' || p_size || '\"^^<http://www.w3.org/2001/XMLSchema#integer>)' FROM part UNION ALL SELECT '{B}part/' || p_partkey, 'AnnotationAssertion(<{SKOS}altLabel> <{B}part/' || p_partkey || '> \"' || p_brand || '\")' FROM part UNION ALL SELECT DISTINCT '{B}line/' || l_orderkey || '-' || l_linenumber, 'SubClassOf(<{B}line/' || l_orderkey || '-' || l_linenumber || '> ObjectSomeValuesFrom(<{B}hasPart> <{B}part/' || l_partkey || '>))' FROM lineitem")
def k02(spark, sf_dir):
    rows = K.axiom_lines(onto(spark, sf_dir, True))
    part = F.col("iri").contains("/part/") & (F.col("line").contains("ptype") | F.col("line").contains("/size>") | F.col("line").contains("altLabel"))
    return rows.where(part | F.col("line").contains("ObjectSomeValuesFrom")).select("iri", "line")


@query("k03_manchester", f"SELECT '{B}part/' || p_partkey AS iri, 'Individual' AS frame, 'Types' AS section, '<{B}brand/' || p_brand || '>, <{B}ptype/' || p_type || '>' AS items FROM part UNION ALL SELECT {CUSTOMER}, 'Class', 'SubClassOf', '<{B}nation/' || c_nationkey || '>' FROM customer")
def k03(spark, sf_dir):
    rows = K.manchester_sections(onto(spark, sf_dir)).drop("onto_id")
    return rows.where("section = 'Types' or section = 'SubClassOf' and iri like '%/customer/%'")


@query("k04_turtle", f"SELECT {CUSTOMER} AS iri, '<' || {CUSTOMER} || '> a <{OWL}Class> ; rdfs:subClassOf <{B}nation/' || c_nationkey || '> ; rdfs:label \"' || c_name || '\"@en ; <{B}segment> \"' || c_mktsegment || '\"@en ; <{B}acctbal> \"' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#decimal> .' AS line FROM customer")
def k04(spark, sf_dir):
    return K.turtle_lines(customers_only(onto(spark, sf_dir))).select("iri", "line")


@query("k05_convert", f"SELECT {CUSTOMER} AS sub, '{B}nation/' || c_nationkey AS sup FROM customer UNION ALL SELECT {NATION}, '{B}region/' || n_regionkey FROM nation")
def k05(spark, sf_dir):
    """Functional text to Manchester text: read, written, and read again."""
    a = axioms(spark, sf_dir)
    routes = S.subclass_routes(a).where("route = 'named'")
    x = onto(spark, sf_dir)
    none = {n: getattr(x, n).where("false") for n in ("label", "annotation", "class_expr", "prop_edge", "prop_flag", "prop_chain", "type_assert", "obj_assert", "data_assert")}
    o = F.lit("shop").alias("onto_id")
    y = replace(x, entity=S.declarations(a).select(o, "iri", "type"), class_edge=routes.select(o, F.col("iri").alias("sub"), F.col("other").alias("sup"), F.lit("sub").alias("kind"), F.lit(0).alias("ord")), **none)
    path = shared_path(spark, "converted")
    K.write_manchester(y, path)
    items = S.manchester(S.lines(spark, path)).where("section = 'SubClassOf'")
    return items.select(F.col("frame").alias("sub"), F.regexp_replace("item", "[<>]", "").alias("sup"))


@query("k06_literals", "SELECT doc_id, '\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\"@' || lang AS lit, 'rdfs:label' AS prop FROM documents")
def k06(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", E.literal(F.col("text"), F.col("lang"), F.lit("")).alias("lit"), E.written_iri(F.lit(LABEL)).alias("prop"))


@query("a03_segments", f"SELECT {CUSTOMER} AS iri, 'entity' AS map, 5 AS n FROM customer UNION ALL SELECT {NATION}, 'entity', 3 FROM nation")
def a03(spark, sf_dir):
    """Lines owned by each entity: declaration, label, edge, and for customers annotation and data."""
    s = S.segments(axioms(spark, sf_dir))
    ordered = (F.col("first_line") <= F.col("last_line")) & (F.element_at("lines", 1) == F.col("first_line")) & (F.element_at("lines", -1) == F.col("last_line"))
    return s.where(ordered & ~F.col("iri").rlike("(hasPart|partOf|madeOf|acctbal|size|segment)$")).select("iri", "map", F.size("lines").alias("n"))


@query("a03_general_axioms", f"SELECT CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 THEN {CUSTOMER} ELSE '{B}nation/' || c_nationkey END AS iri, CASE WHEN c_custkey % 4 < 2 THEN 'entity' ELSE 'gci' END AS map, c_custkey AS line_no FROM customer")
def a03_gci(spark, sf_dir):
    return S.owners(mixed(spark, sf_dir)).select("iri", "map", "line_no")


@query("d06_bad_lines", "SELECT c_custkey AS line_no, left('Unexpected: Nonsense(' || c_name || ')', 300) AS message FROM customer WHERE c_custkey % 5 = 0")
def d06(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("Nonsense("), "c_name", F.lit(")"))).when(k % 5 == 1, "# note").when(k % 5 == 2, "").when(k % 5 == 3, ")").otherwise("  HasKey(<a> () (<b>))")
    return S.bad_lines(c.select(F.lit("f").alias("path"), k.alias("line_no"), text.alias("text"))).select("line_no", "message")


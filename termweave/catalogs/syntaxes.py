"""One ontology through every syntax (S02-S07, K01-K05): written or told as text, read back, all tables compared."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.catalogs.graph import onto
from termweave.catalogs.ingest import block, documents_of
from termweave.model import BASE, LABEL, OWL, Ontology, _values, table
from termweave.plans.tables import shared_path
from termweave.sources import scans as S
from termweave.sources import sinks as K
from termweave.sources import store
from termweave.sources import tables as T

B = BASE
LOCATED = B + "locatedIn"
PROPS = [("hasPart", "objectProperty"), ("partOf", "objectProperty"), ("madeOf", "objectProperty"), ("locatedIn", "objectProperty"), ("rating", "dataProperty"), ("segment", "annotationProperty")]


def model(spark, sf_dir) -> Ontology:
    """Nations and customers as classes with expressions, suppliers as individuals, properties of every sort."""
    x = onto(spark, sf_dir)
    o = F.lit("shop").alias("onto_id")
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    iri = lambda kind, k: F.concat(F.lit(f"{B}{kind}/"), F.col(k).cast("string"))
    ent = lambda d, i, kind: d.select(o, i.alias("iri"), F.lit(kind).alias("type"))
    props = _values(spark, "entity", [("shop", B + p, k) for p, k in PROPS])
    entity = reduce(DataFrame.unionByName, [ent(c, iri("customer", "c_custkey"), "class"), ent(n, iri("nation", "n_nationkey"), "class"), ent(s, iri("supplier", "s_suppkey"), "individual"), props])
    said = F.concat(F.lit(f"{B}hasPart some ({B}nation/"), F.col("c_nationkey").cast("string"), F.lit(f" and ({B}madeOf min 2 {B}nation/0))"))
    role = F.when(F.col("c_custkey") % 3 == 0, "super").when(F.col("c_custkey") % 3 == 1, "equiv").otherwise("gci")
    expr = c.select(o, iri("customer", "c_custkey").alias("iri"), role.alias("role"), F.lit(0).alias("ord"), said.alias("expr"))
    own = lambda d, k, *kinds: d.where(reduce(lambda a, b: a | b, [F.col(k).contains(f"/{kind}/") for kind in kinds]))
    edges = own(x.class_edge, "sub", "customer", "nation")
    apart = n.where("n_nationkey > 0").select(o, iri("nation", "n_nationkey").alias("a"), F.lit(B + "nation/0").alias("b"))
    apart = apart.select("onto_id", F.col("a").alias("sub"), F.col("b").alias("sup"), F.lit("disjoint").alias("kind"), F.lit(0).alias("ord")).unionByName(apart.select("onto_id", F.col("b").alias("sub"), F.col("a").alias("sup"), F.lit("disjoint").alias("kind"), F.lit(0).alias("ord")))
    return replace(
        x,
        entity=entity,
        label=own(x.label, "iri", "customer", "nation"),
        annotation=own(x.annotation, "iri", "customer"),
        class_edge=edges.unionByName(apart),
        class_expr=expr,
        prop_edge=_values(spark, "prop_edge", [("shop", B + "hasPart", B + "partOf", "inverse"), ("shop", B + "partOf", B + "hasPart", "inverse"), ("shop", B + "madeOf", B + "hasPart", "sub"), ("shop", B + "hasPart", B + "nation/0", "domain"), ("shop", LOCATED, B + "nation/1", "range")]),
        prop_flag=_values(spark, "prop_flag", [("shop", B + "hasPart", "transitive"), ("shop", B + "madeOf", "asymmetric")]),
        type_assert=s.select(o, iri("supplier", "s_suppkey").alias("ind"), iri("nation", "s_nationkey").alias("class")),
        data_assert=s.select(o, iri("supplier", "s_suppkey").alias("ind"), F.lit(B + "rating").alias("prop"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("value"), F.lit("http://www.w3.org/2001/XMLSchema#decimal").alias("datatype")),
    )


def told(x: Ontology) -> DataFrame:
    """tbl, a, b, c, d of all tables."""
    row = lambda name, *cols: getattr(x, name).select(F.lit(name).alias("tbl"), *[(c if not isinstance(c, str) else F.col(c) if c else F.lit("")).alias(n) for n, c in zip("abcd", [*cols, "", "", ""])])
    parts = [row("entity", "iri", "type"), row("label", "iri", "text", "lang"), row("annotation", "iri", "prop", "text", "lang"), row("class_edge", "sub", "sup", "kind"), row("class_expr", "iri", "role", "expr"), row("prop_edge", "prop", "target", "kind"), row("prop_flag", "prop", "flag"), row("prop_chain", "prop", F.array_join("members", " ")), row("type_assert", "ind", "class"), row("obj_assert", "ind", "prop", "target"), row("data_assert", "ind", "prop", "value", "datatype")]
    return reduce(DataFrame.unionByName, parts)


CUSTOMER, NATION, SUPPLIER = (f"'{B}{k}/' || {c}" for k, c in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")))
_props = " UNION ALL ".join(f"SELECT 'entity', '{B}{p}', '{k}', '', ''" for p, k in PROPS)
ENTITIES = f"SELECT 'entity' AS tbl, {CUSTOMER} AS a, 'class' AS b, '' AS c, '' AS d FROM customer UNION ALL SELECT 'entity', {NATION}, 'class', '', '' FROM nation UNION ALL SELECT 'entity', {SUPPLIER}, 'individual', '', '' FROM supplier UNION ALL {_props}"
TEXTS = f"SELECT 'label', {CUSTOMER}, c_name, 'en', '' FROM customer UNION ALL SELECT 'label', {NATION}, n_name, 'en', '' FROM nation UNION ALL SELECT 'annotation', {CUSTOMER}, '{B}segment', c_mktsegment, 'en' FROM customer"
EDGES = f"SELECT 'class_edge', {CUSTOMER}, '{B}nation/' || c_nationkey, 'sub', '' FROM customer UNION ALL SELECT 'class_edge', {NATION}, '{B}region/' || n_regionkey, 'sub', '' FROM nation UNION ALL SELECT 'class_edge', {NATION}, '{B}nation/0', 'disjoint', '' FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'class_edge', '{B}nation/0', {NATION}, 'disjoint', '' FROM nation WHERE n_nationkey > 0"
EXPRS = f"SELECT 'class_expr', {CUSTOMER}, CASE c_custkey % 3 WHEN 0 THEN 'super' WHEN 1 THEN 'equiv' ELSE 'gci' END, '{B}hasPart some ({B}nation/' || c_nationkey || ' and ({B}madeOf min 2 {B}nation/0))', '' FROM customer"
PROPERTIES = f"SELECT 'prop_edge', '{B}hasPart', '{B}partOf', 'inverse', '' UNION ALL SELECT 'prop_edge', '{B}partOf', '{B}hasPart', 'inverse', '' UNION ALL SELECT 'prop_edge', '{B}madeOf', '{B}hasPart', 'sub', '' UNION ALL SELECT 'prop_edge', '{B}hasPart', '{B}nation/0', 'domain', '' UNION ALL SELECT 'prop_edge', '{LOCATED}', '{B}nation/1', 'range', '' UNION ALL SELECT 'prop_flag', '{B}hasPart', 'transitive', '', ''"
ASYMMETRIC = f"SELECT 'prop_flag', '{B}madeOf', 'asymmetric', '', ''"
CHAIN = f"SELECT 'prop_chain', '{B}hasPart', '{B}hasPart {B}madeOf', '', ''"
TYPES = f"SELECT 'type_assert', {SUPPLIER}, '{B}nation/' || s_nationkey, '', '' FROM supplier"
FACTS = f"SELECT 'obj_assert', {SUPPLIER}, '{LOCATED}', '{B}nation/' || s_nationkey, '' FROM supplier UNION ALL SELECT 'data_assert', {SUPPLIER}, '{B}rating', CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#decimal' FROM supplier"


def every(*parts: str) -> str:
    return " UNION ALL ".join([ENTITIES, TEXTS, EDGES, PROPERTIES, TYPES, *parts])


@query("k01_functional_round_trip", every(EXPRS, ASYMMETRIC, CHAIN, FACTS))
def functional(spark, sf_dir):
    """K01 and K02 written, S01-S03 read: composite expressions come back as they were."""
    path = shared_path(spark, "functional")
    K.write_functional(model(spark, sf_dir), B, path)
    axioms = S.functional(S.joined_lines(S.lines(spark, path)))
    return told(T.from_axioms(axioms, F.lit("shop")))


def shortened(line):
    """Half of the lines with prefixed names, a third with annotations of their axiom, nested ones and bracketed texts among them."""
    short = F.regexp_replace(line, rf"<{B}(customer|nation|supplier)/(\d+)>", "$1:$2")
    short = F.regexp_replace(F.regexp_replace(short, rf"<{B}(\w+)>", ":$1"), r"<http://www.w3.org/2001/XMLSchema#(\w+)>", "xsd:$1")
    line = F.when(F.crc32(line) % 2 == 0, short).otherwise(line)
    note = 'Annotation(Annotation(rdfs:comment "in turn") rdfs:comment "why (or why not) :x <y> \\\\"z\\\\" Annotation("@en) Annotation (:segment nation:0) '
    return F.when(F.crc32(line) % 3 == 0, F.regexp_replace(line, r"^((?!Prefix|Ontology)[A-Z]\w+\()", "$1" + note)).otherwise(line)


@query("s01_prefixed_names", every(EXPRS, ASYMMETRIC, CHAIN, FACTS))
def prefixed(spark, sf_dir):
    """The document of k01_functional_round_trip with prefixed names and annotated axioms gives the same tables."""
    own = {k: f"{B}{k}/" for k in ("customer", "nation", "supplier")}
    d = K.functional_document(model(spark, sf_dir), B, own, True).orderBy("onto_id", "section", "kind_rank", "iri", "ord", "line")
    path = shared_path(spark, "prefixed")
    d.select(shortened(F.col("line")).alias("line")).write.text(path)
    raw = S.lines(spark, path)
    # a document of many files: its prefixes hold for all of them
    declared = S.prefixes(raw).drop("path").crossJoin(F.broadcast(raw.select("path").distinct()))
    return told(T.from_axioms(S.functional(S.joined_lines(raw)), F.lit("shop"), declared))


@query("s07_all_tables", every(FACTS))
def triples(spark, sf_dir):
    """S13's triples read as tables; they hold no expressions, no chains and not every flag."""
    return told(T.from_triples(store.triples(model(spark, sf_dir))))


@query("k04_turtle_properties", f"SELECT '{B}hasPart' AS iri, '<{B}hasPart> a <{OWL}ObjectProperty> ; a owl:TransitiveProperty ; owl:inverseOf <{B}partOf> ; owl:propertyChainAxiom ( <{B}hasPart> <{B}madeOf> ) ; rdfs:domain <{B}nation/0> .' AS line UNION ALL SELECT '{B}madeOf', '<{B}madeOf> a <{OWL}ObjectProperty> ; a owl:AsymmetricProperty ; rdfs:subPropertyOf <{B}hasPart> .' UNION ALL SELECT {SUPPLIER}, '<' || {SUPPLIER} || '> a <{OWL}NamedIndividual> ; a <{B}nation/' || s_nationkey || '> ; <{LOCATED}> <{B}nation/' || s_nationkey || '> ; <{B}rating> \"' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#decimal> .' FROM supplier")
def turtle(spark, sf_dir):
    return K.turtle_lines(model(spark, sf_dir)).where("iri like '%/supplier/%' or iri rlike '(hasPart|madeOf)$'").select("iri", "line")


def rewritten(line):
    """Frame lines with prefixed names; of some, the section on the frame's line, or a list and an expression over lines, or a comment."""
    short = F.regexp_replace(line, rf"<{B}(customer|nation|supplier)/(\d+)>", "$1:$2")
    short = F.regexp_replace(F.regexp_replace(short, rf"<{B}(\w+)>", ":$1"), r"<http://www.w3.org/2001/XMLSchema#(\w+)>", "xsd:$1")
    k = F.crc32(line) % 3
    line = F.when(k < 2, short).otherwise(line)
    return F.when(k == 1, F.regexp_replace(F.regexp_replace(line, ", ", "  # Types: \"no\n        , "), " and ", "\n and ")).otherwise(line)


@query("s06_all_tables", every(EXPRS + " WHERE c_custkey % 3 < 2", ASYMMETRIC, CHAIN, FACTS))
def manchester(spark, sf_dir):
    """K03's frames, rewritten, read back as tables; frames hold no general axioms.  A third of the edges to nations names them by label."""
    x = model(spark, sf_dir)
    path = shared_path(spark, "manchester")
    lines = K.manchester_lines(x).withColumn("line", rewritten(F.col("line")))
    by_label = F.regexp_replace("line", r"SubClassOf: nation:(\d+)$", "SubClassOf: '@$1'")
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("@"), F.col("n_nationkey").cast("string")).alias("_at"), "n_name")
    lines = lines.withColumn("line", by_label).withColumn("_at", F.regexp_extract("line", r"'(@\d+)'$", 1)).join(F.broadcast(names), "_at", "left")  # nations: 25
    lines = lines.withColumn("line", F.when(F.col("n_name").isNotNull(), F.expr("replace(line, _at, n_name)")).otherwise(F.col("line")))
    lines.repartitionByRange("iri").sortWithinPartitions("iri", "ord", "line").select("line").write.text(path)
    raw = S.lines(spark, path)
    own = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("expansion")) for k, v in (("", B), *((k, f"{B}{k}/") for k in ("customer", "nation", "supplier")))])).alias("p")).select("p.*")
    declared = own.crossJoin(F.broadcast(raw.select("path").distinct())).withColumn("line_no", F.lit(0))
    return told(T.from_manchester(S.manchester(raw), F.lit("shop"), declared))


def broken(line):
    """Turtle statements over several lines, with long strings of both kinds and comments that hold quotes."""
    k = F.crc32(line) % 4
    long = F.regexp_replace(line, r'rdfs:label "([^"]*)"', 'rdfs:label """$1"""')
    other = F.regexp_replace(line, r'rdfs:label "([^"]*)"', "rdfs:label '''$1'''")
    line = F.when(k == 0, long).when(k == 1, other).otherwise(line)
    return F.when(k < 3, F.regexp_replace(line, " ; ", ' # it\'s "a note" """ <x> .\n  ;\n\n  ')).otherwise(line)


@query("s07_turtle_text", every(ASYMMETRIC, CHAIN, FACTS))
def turtle_text(spark, sf_dir):
    """K04's text with its lines broken, read back: all tables but expressions, which K04 does not write."""
    from termweave.sources import turtle as R

    path = shared_path(spark, "turtle")
    lines = K.turtle_lines(model(spark, sf_dir)).select("iri", broken(F.col("line")).alias("line"))
    head = lines.limit(1).select(F.lit("").alias("iri"), F.lit("\n".join(K.TURTLE_HEAD)).alias("line"))
    lines.unionByName(head).coalesce(1).sortWithinPartitions("iri").select("line").write.text(path)  # one document
    return told(T.from_triples(R.triples(spark, path, F.lit("shop"))))


@query("s07_ntriples_text", every(FACTS))
def ntriples_text(spark, sf_dir):
    """S13's triples written as N-Triples and read back as tables."""
    from termweave.sources import turtle as R

    path = shared_path(spark, "ntriples")
    K.ntriples_lines(store.triples(model(spark, sf_dir))).select("line").write.text(path)
    return told(T.from_triples(R.triples(spark, path, F.lit("shop"))))


@query("k05_convert_all", every(ASYMMETRIC, CHAIN, FACTS))
def converted(spark, sf_dir):
    """Functional text to frames, these to Turtle, and that read: all tables but expressions, which Turtle does not carry here."""
    from termweave.sources import convert as C

    paths = [shared_path(spark, n) for n in ("functional", "manchester", "turtle")]
    C.write(model(spark, sf_dir), paths[0], "functional", B)
    C.convert(spark, paths[0], paths[1], "manchester", "functional", B)
    C.convert(spark, paths[1], paths[2], "turtle", "manchester", B)
    return told(C.read(spark, paths[2], "turtle", F.lit("shop")))


def element(tag: str, body, **attrs):
    """An XML element as a column."""
    head = [F.lit(f"<{tag}")] + [p for k, v in attrs.items() for p in (F.lit(f' {k.replace("_", ":")}="'), v if not isinstance(v, str) else F.lit(v), F.lit('"'))]
    return F.concat(*head, F.lit("/>")) if body is None else F.concat(*head, F.lit(">"), *body, F.lit(f"</{tag}>"))


RELATIVE = every(f"SELECT 'class_expr', {CUSTOMER}, CASE c_custkey % 3 WHEN 0 THEN 'super' ELSE 'equiv' END, '{B}hasPart some ({B}nation/' || c_nationkey || ' and ({B}madeOf min 2 {B}nation/0))', '' FROM customer WHERE c_custkey % 3 < 2", ASYMMETRIC, FACTS)


@query("s04_all_tables", RELATIVE.replace(f"'{B}supplier/'", f"'{B}doc#s'") + f" UNION ALL SELECT 'annotation', {NATION}, 'http://www.w3.org/2000/01/rdf-schema#comment', '00' || n_nationkey, '' FROM nation UNION ALL SELECT 'annotation', '{B}doc#s' || s_suppkey, '{B}segment', {NATION.replace('n_nationkey', 's_nationkey')}, '' FROM supplier")
def rdfxml(spark, sf_dir):
    """The model as RDF/XML documents: nested restrictions and sets, typed properties, individuals by relative names, properties of any name."""
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    own = lambda kind, k: F.concat(F.lit(f"{B}{kind}/"), F.col(k).cast("string"))
    ref = lambda tag, v: element(tag, None, rdf_resource=v)
    note = lambda tag, k: element(tag, [F.col(k)], xml_lang="en")
    least = element("owl:Restriction", [ref("owl:onProperty", B + "madeOf"), element("owl:minQualifiedCardinality", [F.lit("2")]), ref("owl:onClass", B + "nation/0")])
    both = element("owl:Class", [element("owl:intersectionOf", [element("rdf:Description", None, rdf_about=own("nation", "c_nationkey")), least], rdf_parseType="Collection")])
    some = element("owl:Restriction", [ref("owl:onProperty", B + "hasPart"), element("owl:someValuesFrom", [both])])
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, element("rdfs:subClassOf", [some])).when(k == 1, element("owl:equivalentClass", [some])).otherwise(F.lit(""))
    custom = element("owl:Class", [note("rdfs:label", "c_name"), note("b:segment", "c_mktsegment"), ref("rdfs:subClassOf", own("nation", "c_nationkey")), said], rdf_about=own("customer", "c_custkey"))
    zero = F.col("n_nationkey") == 0
    apart = F.when(zero, F.lit("@")).otherwise(ref("owl:disjointWith", B + "nation/0"))
    nation = element("owl:Class", [note("rdfs:label", "n_name"), element("rdfs:comment", [F.lit("00"), F.col("n_nationkey").cast("string")]), ref("rdfs:subClassOf", own("region", "n_regionkey")), apart], rdf_about=own("nation", "n_nationkey"))
    others = n.where(~zero).agg(F.array_join(F.array_sort(F.collect_list(ref("owl:disjointWith", own("nation", "n_nationkey")))), "").alias("_all"))
    nation = n.crossJoin(F.broadcast(others)).select(F.replace(nation, F.lit("@"), F.col("_all")).alias("value"))  # one row: 24 nations
    rated = element("b:rating", [F.col("s_acctbal").cast("decimal(18,2)").cast("string")], rdf_datatype="http://www.w3.org/2001/XMLSchema#decimal")
    home = own("nation", "s_nationkey")
    supplier = element("owl:NamedIndividual", [ref("rdf:type", home), ref("b:locatedIn", home), rated, ref("b:segment", home), F.lit('<b:unknown>1</b:unknown>')], rdf_about=F.concat(F.lit("#s"), F.col("s_suppkey").cast("string")))
    tag = {"objectProperty": "owl:ObjectProperty", "dataProperty": "owl:DatatypeProperty", "annotationProperty": "owl:AnnotationProperty"}
    inside = {"hasPart": f'<rdf:type rdf:resource="{OWL}TransitiveProperty"/><owl:inverseOf rdf:resource="{B}partOf"/><rdfs:domain rdf:resource="{B}nation/0"/>', "partOf": f'<owl:inverseOf rdf:resource="{B}hasPart"/>', "madeOf": f'<rdf:type rdf:resource="{OWL}AsymmetricProperty"/><rdfs:subPropertyOf rdf:resource="{B}hasPart"/>', "locatedIn": f'<rdfs:range rdf:resource="{B}nation/1"/>'}
    props = n.where(zero).select(F.explode(F.array(*[F.lit(f'<{tag[t]} rdf:about="{B}{p}">{inside.get(p, "")}</{tag[t]}>') for p, t in PROPS])).alias("value"))
    one = lambda d: d.select(F.lit("rest").alias("n"), "value")
    elements = c.select(block().alias("n"), custom.alias("value")).unionByName(one(nation)).unionByName(s.select(F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 10_000).cast("string")).alias("n"), supplier.alias("value"))).unionByName(one(props))
    return told(T.from_relations(T.rdfxml(spark, documents_of(elements, "rdf:RDF", "rdfxml", f' xmlns:b="{B}" xml:base="{B}doc"')), F.lit("shop")))


@query("s05_all_tables", every(ASYMMETRIC, FACTS))
def owlxml(spark, sf_dir):
    """The model as OWL/XML documents; composite axioms are left out."""
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    own = lambda kind, k: F.concat(F.lit(f"{B}{kind}/"), F.col(k).cast("string"))
    ref = lambda tag, v: element(tag, None, IRI=v)
    declared = lambda tag, v: element("Declaration", [ref(tag, v)])
    note = lambda prop, iri, k: element("AnnotationAssertion", [ref("AnnotationProperty", prop), element("IRI", [iri]), element("Literal", [F.col(k)], xml_lang="en")])
    sub = lambda a, b: element("SubClassOf", [ref("Class", a), ref("Class", b)])
    cust, nat, sup = own("customer", "c_custkey"), own("nation", "n_nationkey"), own("supplier", "s_suppkey")
    composite = element("SubClassOf", [ref("Class", cust), element("ObjectSomeValuesFrom", [ref("ObjectProperty", B + "hasPart"), ref("Class", B + "nation/0")])])
    of = lambda d, key, *axioms: d.select(key.alias("n"), F.explode(F.array(*axioms)).alias("value"))
    customers = of(c, block(), declared("Class", cust), note(LABEL, cust, "c_name"), note(B + "segment", cust, "c_mktsegment"), sub(cust, own("nation", "c_nationkey")), composite)
    nations = of(n, F.lit("n"), declared("Class", nat), note(LABEL, nat, "n_name"), sub(nat, own("region", "n_regionkey"))).unionByName(of(n.where("n_nationkey > 0"), F.lit("n"), element("DisjointClasses", [ref("Class", nat), ref("Class", B + "nation/0")])))
    value = element("DataPropertyAssertion", [ref("DataProperty", B + "rating"), ref("NamedIndividual", sup), element("Literal", [F.col("s_acctbal").cast("decimal(18,2)").cast("string")], datatypeIRI="http://www.w3.org/2001/XMLSchema#decimal")])
    suppliers = of(s, F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 10_000).cast("string")), declared("NamedIndividual", sup), element("ClassAssertion", [ref("Class", own("nation", "s_nationkey")), ref("NamedIndividual", sup)]), element("ObjectPropertyAssertion", [ref("ObjectProperty", LOCATED), ref("NamedIndividual", sup), ref("NamedIndividual", own("nation", "s_nationkey"))]), value)
    tag = {"objectProperty": "ObjectProperty", "dataProperty": "DataProperty", "annotationProperty": "AnnotationProperty"}
    p = lambda name, *iris: f"<{name}>" + "".join(f'<{t} IRI="{B}{i}"/>' for t, i in iris) + f"</{name}>"
    op = "ObjectProperty"
    axioms = [p("Declaration", (tag[t], i)) for i, t in PROPS] + [p("InverseObjectProperties", (op, "hasPart"), (op, "partOf")), p("SubObjectPropertyOf", (op, "madeOf"), (op, "hasPart")), p("ObjectPropertyDomain", (op, "hasPart"), ("Class", "nation/0")), p("ObjectPropertyRange", (op, "locatedIn"), ("Class", "nation/1")), p("TransitiveObjectProperty", (op, "hasPart")), p("AsymmetricObjectProperty", (op, "madeOf"))]
    props = of(n.where("n_nationkey = 0"), F.lit("p"), *map(F.lit, axioms))
    rows = reduce(DataFrame.unionByName, [customers, nations, suppliers, props])
    return told(T.from_relations(T.owlxml(spark, documents_of(rows, "Ontology", "owlxml")), F.lit("shop")))

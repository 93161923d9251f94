"""Axiom rows, triples and XML elements as the tables of an ontology (S02-S07), whatever the syntax they came in."""

from __future__ import annotations

import contextlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions import expressions as X
from termweave.functions.classexpr import manchester_text
from termweave.model import BUILT_IN, KIND_ORDER, LABEL, OWL, RDF, RDFS, SCHEMAS, SKOS, TYPE, TYPE_IRI, Ontology, is_named
from termweave.plans.tables import save
from termweave.sources import scans as S
from termweave.sources.store import EDGE, PROP

O = "onto_id"
#: Flags by their name in axioms and types (fixed values).
FLAGS = {"Functional": "functional", "InverseFunctional": "inverseFunctional", "Transitive": "transitive", "Symmetric": "symmetric", "Reflexive": "reflexive", "Irreflexive": "irreflexive", "Asymmetric": "asymmetric"}
#: Kinds by the word of a frame (fixed values).
MANCHESTER_KINDS = {"Class": "class", "ObjectProperty": "objectProperty", "DataProperty": "dataProperty", "AnnotationProperty": "annotationProperty", "Individual": "individual"}
FLAG_IRI = {OWL + k + "Property": v for k, v in FLAGS.items()}
ALL_EDGES = {**PROP, "equiv": OWL + "equivalentProperty", "disjoint": OWL + "propertyDisjointWith"}


def _of(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _shaped(name: str, *parts: DataFrame) -> DataFrame:
    """The distinct rows of parts in the columns of a table."""
    cols = [c.split() for c in SCHEMAS[name].split(", ")]
    return reduce(DataFrame.unionByName, [p.select(*[F.col(c).cast(t).alias(c) for c, t in cols]) for p in parts]).distinct()


def _literal(c: Column) -> tuple[Column, Column, Column]:
    """Text, language and datatype of a quoted literal; of anything else its text."""
    t = F.rtrim(c)
    end = F.regexp_extract(t, r'"(@[A-Za-z][A-Za-z0-9-]*|\^\^\S+)?$', 1)
    text = F.when(t.startswith('"'), X.unescape(F.substr(t, F.lit(2), F.length(t) - F.length(end) - 2))).otherwise(F.regexp_replace(t, "[<>]", ""))
    return text, F.when(end.startswith("@"), F.substr(end, F.lit(2))).otherwise(""), F.when(end.startswith("^^"), F.regexp_replace(end, r"[\^<>]", "")).otherwise("")


def _numbered(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with ord: 0, 1, ... within keys; keys are one entity's, so no group is large."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy(*keys).orderBy(by)) - 1)


def from_axioms(axioms: DataFrame, onto_id: Column | None = None, prefixes: DataFrame | None = None) -> Ontology:
    """S01 rows (path, line_no, keyword, args) as tables; an ontology is a path, or what onto_id says.

    Names are written out by S11's prefixes (of the file, then the built-in ones) and annotations of
    axioms are passed over, if S.functional_axioms() has not done so.

    Entities that axioms use as subjects without a declaration are declared by it.  Expressions are
    stored in Manchester form; what cannot be read is left out, as are axioms between two expressions,
    which S02's routes report.
    """
    a = S.resolved(axioms, prefixes).withColumn(O, F.col("path") if onto_id is None else onto_id).withColumn("o", S.operands(F.col("args")))
    a = a.withColumn("p", F.transform("o", S.plain)).withColumn("n", F.size("o"))
    a = save(a.select(O, "line_no", "keyword", "args", "o", "p", "n"), "axioms")  # every table reads it
    at = lambda c, i: F.get(c, F.lit(i))
    key = lambda *k: a.where(F.col("keyword").isin(*k))
    both = at("p", 0).isNotNull() & at("p", 1).isNotNull()

    sub = key("SubClassOf")
    edges = sub.where(both).select(O, at("p", 0).alias("sub"), at("p", 1).alias("sup"), F.lit("sub").alias("kind"))
    group = key("EquivalentClasses", "DisjointClasses", "DisjointUnion").select(O, "keyword", "o", "p", F.posexplode("p").alias("i", "x"))
    pair = group.select(O, "keyword", "i", "x", F.posexplode("p").alias("j", "y")).where("x is not null and y is not null and i <> j and x <> y")
    pair = pair.where((F.col("keyword") != "DisjointUnion") | (F.col("i") == 0))
    pairs = pair.select(O, F.col("x").alias("sub"), F.col("y").alias("sup"), F.when(F.col("keyword") == "EquivalentClasses", "equiv").otherwise("disjoint").alias("kind"))
    class_edge = edges.unionByName(pairs).distinct().withColumn("ord", F.lit(0))

    expr = lambda d, role, iri, e: d.select(O, iri.alias("iri"), F.lit(role).alias("role"), e.alias("said"))
    complex_of = group.where("x is not null and keyword = 'EquivalentClasses'").select(O, "x", F.explode(F.filter("o", lambda t: S.plain(t).isNull())).alias("e"))
    said = expr(sub.where(at("p", 0).isNotNull() & at("p", 1).isNull()), "super", at("p", 0), at("o", 1)).unionByName(expr(sub.where(at("p", 0).isNull() & at("p", 1).isNotNull()), "gci", at("p", 1), at("o", 0))).unionByName(expr(complex_of, "equiv", F.col("x"), F.col("e")))
    read = manchester_text(said.select(F.col("said").alias("expr"))).where("manchester is not null").select(F.col("expr").alias("said"), F.col("manchester").alias("expr"))
    class_expr = save(said.join(read, "said").select(O, "iri", "role", F.lit(0).alias("ord"), "expr").distinct(), "expressions")

    edge = lambda d, kind: d.where(both).select(O, at("p", 0).alias("prop"), at("p", 1).alias("target"), F.lit(kind).alias("kind"))
    inverse = edge(key("InverseObjectProperties"), "inverse")
    many = lambda k, kind: key(k).select(O, "p", F.posexplode("p").alias("i", "x")).select(O, "i", "x", F.posexplode("p").alias("j", "y")).where("i <> j and x <> y").select(O, F.col("x").alias("prop"), F.col("y").alias("target"), F.lit(kind).alias("kind"))
    prop_edge = [edge(key("SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf"), "sub"), edge(key("ObjectPropertyDomain", "DataPropertyDomain"), "domain"), edge(key("ObjectPropertyRange"), "range"), inverse, inverse.select(O, F.col("target").alias("prop"), F.col("prop").alias("target"), "kind"), many("EquivalentObjectProperties", "equiv"), many("DisjointObjectProperties", "disjoint")]
    flag = r"^(\w+?)(Object|Data)Property$"
    flags = a.where(F.regexp_extract("keyword", flag, 1).isin(*FLAGS) & (F.col("n") == 1)).select(O, at("p", 0).alias("prop"), _of(F.regexp_extract("keyword", flag, 1), FLAGS).alias("flag"))
    chain = key("SubObjectPropertyOf").where(at("o", 0).startswith("ObjectPropertyChain(")).select(O, "line_no", at("p", 1).alias("prop"), F.regexp_extract_all(at("o", 0), F.lit("<([^>]*)>"), F.lit(1)).alias("members"))
    chains = _numbered(chain, [O, "prop"], "line_no").select(O, "prop", F.col("ord").alias("chain_no"), "members")

    types = key("ClassAssertion").where(both).select(O, at("p", 1).alias("ind"), at("p", 0).alias("class"))
    objects = key("ObjectPropertyAssertion").where("n = 3").select(O, at("p", 1).alias("ind"), at("p", 0).alias("prop"), at("p", 2).alias("target"))
    value, _, dt = _literal(at("o", 2))
    values = key("DataPropertyAssertion").where("n = 3").select(O, at("p", 1).alias("ind"), at("p", 0).alias("prop"), value.alias("value"), dt.alias("datatype"))

    declared = key("Declaration").select(O, F.regexp_extract("args", r"^\s*\w+\s*\(\s*<([^>]*)>", 1).alias("iri"), _of(F.regexp_extract("args", r"^\s*(\w+)", 1), S.KINDS).alias("type")).where("type is not null and iri <> ''")
    used = lambda d, c, kind: d.select(O, F.col(c).alias("iri"), F.lit(kind).alias("type"))
    kind_of = F.when(F.col("keyword").contains("Data"), "dataProperty").when(F.col("keyword").contains("Annotation"), "annotationProperty").otherwise("objectProperty")
    subject = F.coalesce(at("p", 0), F.when(at("o", 0).startswith("ObjectPropertyChain("), at("p", 1)))
    props = a.where(F.col("keyword").rlike("Propert(y|ies|yOf|yDomain|yRange)$") & subject.isNotNull()).select(O, subject.alias("iri"), kind_of.alias("type"))
    seen = reduce(DataFrame.unionByName, [used(class_edge, "sub", "class"), used(class_expr, "iri", "class"), props, used(types, "ind", "individual"), used(objects, "ind", "individual")]).distinct()
    entity = declared.unionByName(seen.join(declared.select(O, "iri"), [O, "iri"], "left_anti"))

    prop = F.regexp_replace(at("o", 0), "[<>]", "")
    text, lang, _ = _literal(at("o", 2))
    notes = key("AnnotationAssertion").where("n = 3").select(O, "line_no", at("p", 1).alias("iri"), prop.alias("prop"), text.alias("text"), lang.alias("lang"))
    notes = _numbered(notes.join(entity.select(O, "iri").distinct(), [O, "iri"], "left_semi"), [O, "iri", "prop"], "line_no")
    raw = F.when(F.col("lang") != "", F.concat("text", F.lit("@"), "lang")).otherwise(F.col("text"))
    return Ontology(
        entity=_shaped("entity", entity),
        label=_shaped("label", notes.where(F.col("prop") == LABEL)),
        annotation=_shaped("annotation", notes.where(F.col("prop") != LABEL).withColumn("raw", raw)),
        class_edge=_shaped("class_edge", class_edge),
        class_expr=_shaped("class_expr", class_expr),
        prop_edge=_shaped("prop_edge", *prop_edge),
        prop_flag=_shaped("prop_flag", flags),
        prop_chain=_shaped("prop_chain", chains),
        type_assert=_shaped("type_assert", types),
        obj_assert=_shaped("obj_assert", objects),
        data_assert=_shaped("data_assert", values),
    )


def _labelled(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items with the quoted labels in them as <IRI>, by the labels of the same ontology; unknown ones stay."""
    named = save(labels.groupBy(O, F.col("text").alias("t")).agg(F.min("iri").alias("iri")), "names")
    quoted = F.col("item").contains("'") & ~F.col("section").isin("Annotations", "Facts")
    items = save(items, "items")
    toks = items.where(quoted).select(O, "item").distinct().select(O, "item", F.posexplode(X.tokens(F.col("item"))).alias("i", "tok"))
    toks = toks.withColumn("t", F.when(F.col("tok").rlike("(?s)^'.*'$"), F.regexp_replace("tok", "^'|'$", ""))).join(named, [O, "t"], "left")
    full = F.coalesce(F.concat(F.lit("<"), "iri", F.lit(">")), "tok")
    read = toks.groupBy(O, "item").agg(F.array_sort(F.collect_list(F.struct("i", full.alias("x")))).alias("p")).select(O, "item", F.array_join("p.x", "").alias("read"))
    out = items.where(quoted).join(read, [O, "item"]).withColumn("item", F.col("read")).drop("read")
    return items.where(~quoted).unionByName(out)


def from_manchester(items: DataFrame, onto_id: Column | None = None, prefixes: DataFrame | None = None) -> Ontology:
    """S06's rows as tables; an ontology is a path, or what onto_id says.

    Names are written out by S11's prefixes, quoted labels by the labels of the ontology.  Classes are
    equivalent and disjoint as their frames say, in lists each with each.  Types that are expressions,
    negative facts, SameAs and DifferentFrom have no table; expressions that cannot be read are left out.
    """
    own = items.withColumn("prefixes", F.lit(None).cast("map<string,string>")) if prefixes is None else S.with_prefixes(items, prefixes)
    full = lambda c: F.array_join(F.transform(X.tokens(c), lambda t: S.full_name(t, F.col("prefixes"))), "")
    bare = F.regexp_replace(full(F.when(is_named(F.col("frame")), F.concat(F.lit("<"), "frame", F.lit(">"))).otherwise(F.col("frame"))), "[<>]", "")
    own = own.withColumn(O, F.col("path") if onto_id is None else onto_id).withColumn("frame", bare).withColumn("item", full(F.col("item")))
    own = save(own.select(O, "path", "line_no", "frame", "kind", "section", "item"), "frames")
    sec = lambda d, *names: d.where(F.col("section").isin(*names))
    entity = own.where("section = ''").select(O, F.col("frame").alias("iri"), _of(F.col("kind"), MANCHESTER_KINDS).alias("type"))

    head = r"(?s)^<([^>]*)>\s+(.*)$"
    noted = sec(own, "Annotations").select(O, "line_no", F.col("frame").alias("iri"), F.regexp_extract("item", head, 1).alias("prop"), F.regexp_extract("item", head, 2).alias("v")).where("prop <> ''")
    text, lang, _ = _literal(F.col("v"))
    notes = _numbered(noted.select(O, "iri", "prop", text.alias("text"), lang.alias("lang"), F.struct("line_no", "v").alias("_k")), [O, "iri", "prop"], "_k")
    raw = F.when(F.col("lang") != "", F.concat("text", F.lit("@"), "lang")).otherwise(F.col("text"))
    label = save(_shaped("label", notes.where(F.col("prop") == LABEL)), "labels")

    own = save(_labelled(own.where("section <> '' and section <> 'Annotations'"), label), "items")
    plain = F.coalesce(S.plain(F.col("item")), F.when(is_named(F.col("item")) & ~F.col("item").rlike(r"[\s({]"), F.col("item")))
    own = own.withColumn("x", plain)
    of_class, of_prop = own.where("kind = 'Class'"), own.where(F.col("kind").endswith("Property"))
    link = _of(F.col("section"), {"SubClassOf": "sub", "EquivalentTo": "equiv", "DisjointWith": "disjoint"})
    edges = sec(of_class, "SubClassOf", "EquivalentTo", "DisjointWith").where("x is not null").select(O, F.col("frame").alias("sub"), F.col("x").alias("sup"), link.alias("kind"))
    lists = own.where(F.col("kind").isin(*S.LISTS) & F.col("x").isNotNull()).select(O, "path", "line_no", "kind", "x")
    both = lists.join(lists.select("path", "line_no", "kind", F.col("x").alias("y")), ["path", "line_no", "kind"]).where("x <> y")
    pairs = both.select(O, F.col("x").alias("sub"), F.col("y").alias("sup"), _of(F.col("kind"), {"EquivalentClasses": "equiv", "DisjointClasses": "disjoint"}).alias("kind"))
    said = sec(of_class, "SubClassOf", "EquivalentTo").where("x is null").select(O, F.col("frame").alias("iri"), F.when(F.col("section") == "SubClassOf", "super").otherwise("equiv").alias("role"), F.col("item").alias("said"))
    read = manchester_text(said.select(F.col("said").alias("expr"))).where("manchester is not null").select(F.col("expr").alias("said"), F.col("manchester").alias("expr"))
    edge = _of(F.col("section"), {"SubPropertyOf": "sub", "Domain": "domain", "Range": "range", "InverseOf": "inverse", "EquivalentTo": "equiv", "DisjointWith": "disjoint"})
    prop_edge = of_prop.where(edge.isNotNull() & F.col("x").isNotNull()).select(O, F.col("frame").alias("prop"), F.col("x").alias("target"), edge.alias("kind"))
    flags = sec(of_prop, "Characteristics").select(O, F.col("frame").alias("prop"), _of(F.col("item"), FLAGS).alias("flag")).where("flag is not null")
    chain = sec(of_prop, "SubPropertyChain").select(O, F.struct("line_no", "item").alias("_k"), F.col("frame").alias("prop"), F.regexp_extract_all("item", F.lit("<([^>]*)>"), F.lit(1)).alias("members")).where(F.size("members") >= 2)
    chains = _numbered(chain, [O, "prop"], "_k").select(O, "prop", F.col("ord").alias("chain_no"), "members")
    of_ind = own.where("kind = 'Individual'")
    types = sec(of_ind, "Types").where("x is not null").select(O, F.col("frame").alias("ind"), F.col("x").alias("class"))
    facts = sec(of_ind, "Facts").select(O, F.col("frame").alias("ind"), F.regexp_extract("item", head, 1).alias("prop"), F.regexp_extract("item", head, 2).alias("v")).where("prop <> ''")
    value, _, dt = _literal(F.col("v"))
    is_text = F.col("v").startswith('"')
    # classes that stand in lists only are classes too
    listed = pairs.select(O, F.col("sub").alias("iri"), F.lit("class").alias("type")).distinct()
    return Ontology(
        entity=_shaped("entity", entity, listed.join(entity.select(O, "iri"), [O, "iri"], "left_anti")),
        label=label,
        annotation=_shaped("annotation", notes.where(F.col("prop") != LABEL).withColumn("raw", raw)),
        class_edge=_shaped("class_edge", edges.unionByName(pairs).withColumn("ord", F.lit(0))),
        class_expr=_shaped("class_expr", said.join(read, "said").withColumn("ord", F.lit(0))),
        prop_edge=_shaped("prop_edge", prop_edge),
        prop_flag=_shaped("prop_flag", flags),
        prop_chain=_shaped("prop_chain", chains),
        type_assert=_shaped("type_assert", types),
        obj_assert=_shaped("obj_assert", facts.where(~is_text & S.plain(F.col("v")).isNotNull()).select(O, "ind", "prop", S.plain(F.col("v")).alias("target"))),
        data_assert=_shaped("data_assert", facts.where(is_text).select(O, "ind", "prop", value.alias("value"), dt.alias("datatype"))),
    )


def from_triples(t: DataFrame) -> Ontology:
    """Triples as tables: kinds by rdf:type, named subjects only, an individual's assertions by the predicate's kind.

    Property chains are lists of two properties or more; chain_no follows their members.  Expressions are not read.
    """
    named = save(t.where(is_named(F.col("s"))), "named")  # every table reads both
    entity = save(S.entities_from_triples(named), "entities")
    of = lambda *kinds: entity.where(F.col("type").isin(*kinds))
    mine = lambda kind, c="iri": named.join(of(kind).select(O, F.col("iri").alias("s")), [O, "s"], "left_semi")
    to_iri = F.col("o_kind") == "iri"
    back = lambda table: {v: k for k, v in table.items()}
    classes = mine("class").where(to_iri & F.col("p").isin(*EDGE.values()) & is_named(F.col("o")))
    properties = named.join(of("objectProperty", "dataProperty", "annotationProperty").select(O, F.col("iri").alias("s")), [O, "s"], "left_semi").where(to_iri)
    notes = named.where(F.col("o_kind") == "lit").join(of("annotationProperty").select(O, F.col("iri").alias("p")), [O, "p"], "left_semi")
    notes = notes.unionByName(named.where((F.col("o_kind") == "lit") & F.col("p").isin(*BUILT_IN))).distinct()
    notes = notes.select(O, F.col("s").alias("iri"), F.col("p").alias("prop"), F.col("o").alias("text"), F.coalesce("o_lang", F.lit("")).alias("lang"))
    notes = _numbered(notes.withColumn("_k", F.struct("lang", "text")), [O, "iri", "prop"], "_k")
    raw = F.when(F.col("lang") != "", F.concat("text", F.lit("@"), "lang")).otherwise(F.col("text"))
    facts = S.assertions_from_triples(named, entity)
    dt = named.select(O, F.col("s").alias("ind"), F.col("p").alias("prop"), F.col("o").alias("value"), F.coalesce("o_dt", F.lit("")).alias("datatype"))
    types = mine("individual").where(to_iri & (F.col("p") == TYPE) & ~F.col("o").isin(*TYPE_IRI.values()))
    none = lambda name: t.sparkSession.createDataFrame([], SCHEMAS[name])
    return Ontology(
        entity=_shaped("entity", entity),
        label=_shaped("label", notes.where(F.col("prop") == LABEL)),
        annotation=_shaped("annotation", notes.where(F.col("prop") != LABEL).withColumn("raw", raw)),
        class_edge=_shaped("class_edge", classes.select(O, F.col("s").alias("sub"), F.col("o").alias("sup"), _of(F.col("p"), back(EDGE)).alias("kind"), F.lit(0).alias("ord"))),
        class_expr=none("class_expr"),
        prop_edge=_shaped("prop_edge", properties.where(F.col("p").isin(*ALL_EDGES.values())).select(O, F.col("s").alias("prop"), F.col("o").alias("target"), _of(F.col("p"), back(ALL_EDGES)).alias("kind"))),
        prop_flag=_shaped("prop_flag", properties.where((F.col("p") == TYPE) & F.col("o").isin(*FLAG_IRI)).select(O, F.col("s").alias("prop"), _of(F.col("o"), FLAG_IRI).alias("flag"))),
        prop_chain=_shaped("prop_chain", chains_of(t, of("objectProperty"))),
        type_assert=_shaped("type_assert", types.select(O, F.col("s").alias("ind"), F.col("o").alias("class"))),
        obj_assert=_shaped("obj_assert", facts.where("kind = 'object'").withColumnRenamed("value", "target")),
        data_assert=_shaped("data_assert", facts.where("kind = 'data'").join(dt, [O, "ind", "prop", "value"])),
    )


def chains_of(t: DataFrame, properties: DataFrame) -> DataFrame:
    """onto_id, prop, chain_no, members of the property chains of object properties, from their lists."""
    cell = lambda c: F.concat_ws("\u0001", O, c)
    is_p = lambda p: t.where(F.col("p") == p)
    said = is_p(OWL + "propertyChainAxiom").where("o_kind <> 'lit'").join(properties.select(O, F.col("iri").alias("s")), [O, "s"], "left_semi")
    said = save(said.select(O, F.col("s").alias("prop"), cell("o").alias("head")), "chains")
    if said.isEmpty():
        return t.sparkSession.createDataFrame([], SCHEMAS["prop_chain"])
    first = is_p(RDF + "first").select(cell("s").alias("node"), F.col("o").alias("item"))
    rest = is_p(RDF + "rest").select(cell("s").alias("node"), cell("o").alias("next"))
    found = S.rdf_lists(first, rest, said.select("head").distinct())
    lists = found.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("members")).where(F.size("members") >= 2)
    rows = said.join(lists, "head").select(O, "prop", "members").distinct().withColumn("_k", F.array_join("members", " "))
    return _numbered(rows, [O, "prop"], "_k").withColumnRenamed("ord", "chain_no")


# ---------------------------------------------------------------- XML

#: Children of node elements (fixed values): annotation properties, and the edges of classes and properties.
NOTES = {f"{p}:{iri[len(ns):]}": iri for p, ns in (("rdfs", RDFS), ("skos", SKOS), ("owl", OWL)) for iri in BUILT_IN if iri.startswith(ns)}
CLASS_CHILDREN = {"rdfs:subClassOf": "super", "owl:equivalentClass": "equiv", "owl:disjointWith": "disjoint"}
PROPERTY_CHILDREN = {"rdfs:subPropertyOf": "sub", "rdfs:domain": "domain", "rdfs:range": "range", "owl:inverseOf": "inverse", "owl:equivalentProperty": "equiv", "owl:propertyDisjointWith": "disjoint"}
NODE_KINDS = {"owl:Class": "class", "owl:ObjectProperty": "objectProperty", "owl:DatatypeProperty": "dataProperty", "owl:AnnotationProperty": "annotationProperty", "owl:NamedIndividual": "individual"}
_SETS = ("owl:intersectionOf", "owl:unionOf", "owl:complementOf", "owl:oneOf")
_CLASS = "struct<`_rdf:about`:string," + ",".join(f"`{c}`:string" for c in _SETS) + ">"
_CHILD = f"array<struct<`_rdf:resource`:string,`owl:Restriction`:string,`owl:Class`:{_CLASS},`rdf:Description`:struct<`_rdf:about`:string>>>"
_NOTE = "array<struct<_VALUE:string,`_xml:lang`:string>>"
_REF = "array<struct<`_rdf:resource`:string>>"
_HEAD = "".join(f' xmlns:{p}="{ns}"' for p, ns in (("rdf", TYPE[:-4]), ("rdfs", RDFS), ("owl", OWL)))


def _expression(fragment: str, base: str = "") -> str | None:
    """The Manchester text of a class element, relative names against base; None if it has forms without one."""
    from xml.etree import ElementTree

    rdf, owl = "{" + TYPE[:-4] + "}", "{" + OWL + "}"
    counts = {"minCardinality": "min", "maxCardinality": "max", "cardinality": "exactly", "minQualifiedCardinality": "min", "maxQualifiedCardinality": "max", "qualifiedCardinality": "exactly"}

    def name(e) -> str:
        own = e.get(rdf + "about") or e.get(rdf + "resource") or ""
        if not own or own.startswith(("http", "urn", "file")):
            return own
        return base + own if own.startswith("#") else f"{base}#{own}"

    def inner(e) -> str:
        return name(e) if name(e) or not len(e) else part(e[0])

    def closed(text: str) -> str:
        return f"({text})" if " " in text else text

    def part(e) -> str:
        if name(e):
            return name(e)
        kids = {c.tag.replace(owl, ""): c for c in e}
        if "onProperty" in kids:
            prop = name(kids["onProperty"])
            for tag, word in (("someValuesFrom", "some"), ("allValuesFrom", "only"), ("hasValue", "value")):
                if tag in kids:
                    return f"{prop} {word} {closed(inner(kids[tag]) or (kids[tag].text or '').strip())}"
            for tag, word in counts.items():
                if tag in kids:
                    on = [closed(inner(kids[c])) for c in ("onClass", "onDataRange") if c in kids]
                    return " ".join([prop, word, (kids[tag].text or "").strip(), *on])
            raise ValueError("restriction")
        for tag, word in (("intersectionOf", " and "), ("unionOf", " or ")):
            if tag in kids:
                return word.join(closed(part(c)) for c in kids[tag])
        if "complementOf" in kids:
            return f"not {closed(inner(kids['complementOf']))}"
        if "oneOf" in kids:
            return "{" + ", ".join(part(c) for c in kids["oneOf"]) + "}"
        raise ValueError("class")

    try:
        return part(ElementTree.fromstring(f"<x{_HEAD}>{fragment}</x>")[0])
    except (ValueError, IndexError, ElementTree.ParseError):
        return None


def _notes(child: str, iri: str) -> Column:
    """p, v, l of the elements of one annotation property; none if there are none."""
    each = F.transform(F.col(f"`{child}`"), lambda x: F.struct(F.lit(iri).alias("p"), x["_VALUE"].alias("v"), F.coalesce(x["_xml:lang"], F.lit("")).alias("l")))
    return F.coalesce(each, F.array().cast("array<struct<p:string,v:string,l:string>>"))


def _expressions(fragments: DataFrame) -> DataFrame:
    """fragment, base, expr of the distinct fragments."""
    import pandas as pd

    def read(batches):
        for b in batches:
            yield pd.DataFrame({"fragment": b["fragment"], "base": b["base"], "expr": [_expression(f, x) for f, x in zip(b["fragment"], b["base"])]})

    return fragments.select("fragment", "base").distinct().mapInPandas(read, "fragment string, base string, expr string")


def xml_heads(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """path, base, namespaces of RDF/XML files: from xml:base, else the default namespace without its #, else the
    ontology's IRI, else `base`; of a name that is declared again the first counts."""
    q = r"""\s*=\s*["']([^"']*)["']"""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").alias("t"))
    raw = save(raw.where(F.col("t").rlike("xmlns|xml:base|owl:Ontology|rdf:RDF")), "heads")
    one = lambda kind, form: raw.where(F.col("t").rlike(form)).select("path", "at", F.lit(kind).alias("name"), F.regexp_extract("t", form, 1).alias("v"))
    spaces = raw.select("path", "at", F.explode(F.arrays_zip(F.regexp_extract_all("t", F.lit(r"xmlns:([\w.-]+)" + q), F.lit(1)).alias("k"), F.regexp_extract_all("t", F.lit(r"xmlns:([\w.-]+)" + q), F.lit(2)).alias("v"))).alias("x")).select("path", "at", F.concat(F.col("x.k"), F.lit(":")).alias("name"), F.col("x.v").alias("v"))
    parts = [spaces, one("1base", r"xml:base" + q), one("2default", r"xmlns" + q), one("3ontology", r"owl:Ontology\s[^>]*rdf:about" + q), raw.select("path", "at", F.lit("4none").alias("name"), F.lit(base).alias("v"))]
    first = reduce(DataFrame.unionByName, parts).groupBy("path", "name").agg(F.min_by("v", "at").alias("v"))
    got = first.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("m"))
    base_ = F.coalesce(F.try_element_at("m", F.lit("1base")), F.try_element_at("m", F.lit("2default")), F.try_element_at("m", F.lit("3ontology")), F.col("m")["4none"])
    return save(got.select("path", F.regexp_replace(base_, "#$", "").alias("base"), F.coalesce(F.try_element_at("m", F.lit("2default")), F.lit("")).alias("default"), F.col("m").alias("namespaces")), "heads")


@contextlib.contextmanager
def _exact_case(spark: SparkSession):
    """Names of elements that differ in case only are different names; the session's setting comes back."""
    key = "spark.sql.caseSensitive"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _other_children(spark: SparkSession, path: str, tag: str, known: list[str]) -> list[list[str]]:
    """Names of the child elements of a node element but the known ones, as Spark's reader infers them: the properties
    that the files use; in lists without names that differ in case only."""
    with _exact_case(spark):
        fields = spark.read.format("xml").option("rowTag", tag).option("inferSchema", "false").option("recursiveFileLookup", "true").load(path).schema.names
    out: list[dict] = []
    for n in fields:
        if not n.startswith("_") and n not in known:
            into = next((d for d in out if n.lower() not in d), None)
            if into is None:
                out.append(into := {})
            into[n.lower()] = n
    return [list(d.values()) for d in out]


_SAID = "array<struct<_VALUE:string,`_xml:lang`:string,`_rdf:datatype`:string,`_rdf:resource`:string>>"


def _told_by(child: str) -> Column:
    """n, v, l, t, r (name, text, language, datatype, resource) of the child elements of one name; none if there are none."""
    each = F.transform(F.col(f"`{child}`"), lambda x: F.struct(F.lit(child).alias("n"), x["_VALUE"].alias("v"), x["_xml:lang"].alias("l"), x["_rdf:datatype"].alias("t"), x["_rdf:resource"].alias("r")))
    return F.coalesce(each, F.array().cast("array<struct<n:string,v:string,l:string,t:string,r:string>>"))


def rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Iri, kind, relation, value, lang of the node elements of RDF/XML files.

    relation: declared; label, or the IRI of an annotation property; super, equiv, disjoint with a named
    class, super_expr, equiv_expr with an expression; sub, domain, range, inverse, equiv, disjoint of
    properties; flag; type of individuals; and of elements of any other name `stated` (a resource, with
    the property in lang) and `said` (a text, with property, language and datatype in lang), which
    from_relations() reads by what the property is declared as.  Relative names count from their file's
    base (xml_heads()), which `base` is where a file has none.  Anonymous nodes are read where they stand.
    """
    none = F.lit("").alias("lang")
    heads = xml_heads(spark, path, base)
    heads = F.broadcast(heads) if heads.count() <= S.BROADCAST_FILES else heads
    prefix = lambda c: F.try_element_at("namespaces", F.regexp_extract(c, "^([^:#/]+:)", 1))
    full = lambda c: F.when(is_named(c), c).when(c.startswith("#"), F.concat("base", c)).when(prefix(c).isNotNull(), F.concat(prefix(c), F.substring_index(c, ":", -1))).otherwise(F.concat("base", F.lit("#"), c))
    own_names = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in (("rdf:", RDF), ("rdfs:", RDFS), ("owl:", OWL), ("skos:", SKOS))]))
    tag_iri = lambda t: F.when(t.contains(":"), F.concat(F.coalesce(F.try_element_at("namespaces", F.concat(F.substring_index(t, ":", 1), F.lit(":"))), F.try_element_at(own_names, F.concat(F.substring_index(t, ":", 1), F.lit(":")))), F.substring_index(t, ":", -1))).when(F.col("default") != "", F.concat("default", t))
    parts = []
    for tag, kind in NODE_KINDS.items():
        children = {"class": CLASS_CHILDREN, "individual": {}}.get(kind, PROPERTY_CHILDREN)
        cols = ["`_rdf:about` string", "`_rdf:ID` string", f"`rdf:type` {_REF}", *(f"`{n}` {_NOTE}" for n in NOTES)]
        cols += [f"`{c}` {_CHILD if kind == 'class' or c in ('rdfs:domain', 'rdfs:range') else _REF}" for c in children]
        out = lambda d, relation, value, lang=none: d.select("iri", "kind", (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"), value.alias("value"), lang.alias("lang")).where("value is not null")

        def read(fields: list[str], tag=tag, kind=kind) -> DataFrame:
            """The elements with their IRI, written once: every relation reads them."""
            with _exact_case(spark):
                rows = save(spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(", ".join(fields)).load(path).select("*", F.col("_metadata.file_path").alias("path")), "elements")
            rows = rows.join(heads, "path")
            iri = F.coalesce(full(F.col("`_rdf:about`")), F.concat("base", F.lit("#"), "`_rdf:ID`"))
            return rows.withColumn("iri", iri).withColumn("kind", F.lit(kind)).where("iri is not null")

        rows = read(cols)
        parts.append(out(rows, "declared", F.col("kind")))
        notes = F.flatten(F.array(*[_notes(n, iri) for n, iri in NOTES.items()]))
        note = rows.select("iri", "kind", F.explode(notes).alias("n"))
        parts.append(out(note, F.when(F.col("n.p") == LABEL, "label").otherwise(F.col("n.p")), F.col("n.v"), F.col("n.l")))
        typed = rows.select("iri", "kind", "base", "namespaces", F.explode("`rdf:type`").alias("t")).select("iri", "kind", full(F.col("t.`_rdf:resource`")).alias("t"))
        parts.append(out(typed.where(~F.col("t").isin(*TYPE_IRI.values(), *FLAG_IRI)), "type", F.col("t")))
        parts.append(out(typed, "flag", _of(F.col("t"), FLAG_IRI)))
        for child, relation in children.items():
            c = rows.select("iri", "kind", "base", "namespaces", F.explode(f"`{child}`").alias("c"))
            if kind != "class" and child not in ("rdfs:domain", "rdfs:range"):
                parts.append(out(c, relation, full(F.col("c.`_rdf:resource`"))))
                continue
            parts.append(out(c, relation, full(F.coalesce(F.col("c.`_rdf:resource`"), F.col("c.`owl:Class`.`_rdf:about`"), F.col("c.`rdf:Description`.`_rdf:about`")))))
            wrap = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
            sets = F.coalesce(*[wrap("owl:Class", wrap(s, F.col(f"c.`owl:Class`.`{s}`"))) for s in _SETS])
            said = c.withColumn("fragment", F.coalesce(wrap("owl:Restriction", F.col("c.`owl:Restriction`")), sets)).where("fragment is not null")
            parts.append(out(said.join(_expressions(said), ["fragment", "base"]), f"{relation}_expr", F.col("expr")))
        for names in _other_children(spark, path, tag, ["rdf:type", *NOTES, *children]):
            more = read(["`_rdf:about` string", "`_rdf:ID` string", *(f"`{n}` {_SAID}" for n in names)])
            each = F.flatten(F.array(*[_told_by(n) for n in names]))
            got = more.select("iri", "kind", "base", "namespaces", "default", F.explode(each).alias("c")).withColumn("p", tag_iri(F.col("c.n"))).where("p is not null")
            parts.append(out(got, "stated", full(F.col("c.r")), F.col("p")))
            parts.append(out(got.where("c.r is null"), "said", F.col("c.v"), F.concat_ws("\u0001", "p", F.coalesce("c.l", F.lit("")), F.coalesce(full(F.col("c.t")), F.lit("")))))
    return reduce(DataFrame.unionByName, parts).distinct()


def from_relations(rows: DataFrame, onto_id: Column) -> Ontology:
    """(iri, kind, relation, value, lang) as tables."""
    r = save(rows.withColumn(O, onto_id), "relations")  # every table reads it
    is_class, is_prop = F.col("kind") == "class", F.col("kind").isin("objectProperty", "dataProperty", "annotationProperty")
    rel = lambda *k: r.where(F.col("relation").isin(*k))
    part = lambda n: F.split_part("lang", F.lit("\u0001"), F.lit(n))
    # what elements of any name say, by what their property is declared as
    props = rel("declared").where(is_prop).groupBy(O, F.col("iri").alias("prop")).agg(F.collect_set("kind").alias("kinds"))
    any_ = save(rel("stated", "said").withColumn("prop", part(1)).join(props, [O, "prop"]), "any")
    having = lambda kind, relation: any_.where(F.array_contains("kinds", kind) & (F.col("relation") == relation))
    on_ind = F.col("kind") == "individual"
    links = having("objectProperty", "stated").where(on_ind).select(O, F.col("iri").alias("ind"), "prop", F.col("value").alias("target"))
    values = having("dataProperty", "said").where(on_ind).select(O, F.col("iri").alias("ind"), "prop", "value", part(3).alias("datatype"))
    own_notes = any_.where(F.array_contains("kinds", "annotationProperty")).select(O, "iri", "kind", F.col("prop").alias("relation"), "value", F.when(F.col("relation") == "said", part(2)).otherwise("").alias("lang"))
    noted = r.where((F.col("relation") == "label") | is_named(F.col("relation"))).unionByName(own_notes)
    notes = _numbered(noted.withColumn("_k", F.struct("lang", "value")), [O, "iri", "relation"], "_k").withColumnRenamed("value", "text")
    raw = F.when(F.col("lang") != "", F.concat("text", F.lit("@"), "lang")).otherwise(F.col("text"))
    zero = F.lit(0).alias("ord")
    none = lambda name: rows.sparkSession.createDataFrame([], SCHEMAS[name])
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    return Ontology(
        entity=_shaped("entity", rel("declared").groupBy(O, "iri").agg(F.min_by("kind", rank).alias("type"))),
        label=_shaped("label", notes.where("relation = 'label'")),
        annotation=_shaped("annotation", notes.where("relation <> 'label'").withColumn("prop", F.col("relation")).withColumn("raw", raw)),
        class_edge=_shaped("class_edge", rel("super", "equiv", "disjoint").where(is_class).select(O, F.col("iri").alias("sub"), F.col("value").alias("sup"), F.regexp_replace("relation", "super", "sub").alias("kind"), zero)),
        class_expr=_shaped("class_expr", rel("super_expr", "equiv_expr").where(is_class).select(O, "iri", F.regexp_replace("relation", "_expr", "").alias("role"), zero, F.col("value").alias("expr"))),
        prop_edge=_shaped("prop_edge", rel(*ALL_EDGES).where(is_prop).select(O, F.col("iri").alias("prop"), F.col("value").alias("target"), F.col("relation").alias("kind"))),
        prop_flag=_shaped("prop_flag", rel("flag").where(is_prop).select(O, F.col("iri").alias("prop"), F.col("value").alias("flag"))),
        prop_chain=none("prop_chain"),
        type_assert=_shaped("type_assert", rel("type").where("kind = 'individual'").select(O, F.col("iri").alias("ind"), F.col("value").alias("class"))),
        obj_assert=_shaped("obj_assert", links, rel("object").select(O, F.col("iri").alias("ind"), F.col("lang").alias("prop"), F.col("value").alias("target"))),
        data_assert=_shaped("data_assert", values, rel("data").select(O, F.col("iri").alias("ind"), part(1).alias("prop"), "value", part(2).alias("datatype"))),
    )


_ONE, _MANY = "struct<_IRI:string>", "array<struct<_IRI:string>>"
_NAMES = {"Class": "class", "ObjectProperty": "objectProperty", "DataProperty": "dataProperty", "AnnotationProperty": "annotationProperty", "NamedIndividual": "individual"}


def owlxml(spark: SparkSession, path: str) -> DataFrame:
    """Iri, kind, relation, value, lang of the axiom elements of OWL/XML files, as rdfxml() tells them.

    Axioms with composite operands are left out.  Assertions are relations `object` and `data` with the
    property (and the datatype) in lang.  Each kind of axiom is a scan of its own.
    """

    def read(tag: str, **cols) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in cols.items()) + ", xs_any array<string>"
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where("xs_any is null")

    def out(d: DataFrame, iri: Column, kind: str, relation, value: Column, lang: Column | None = None) -> DataFrame:
        rel = F.lit(relation) if isinstance(relation, str) else relation
        row = d.select(iri.alias("iri"), F.lit(kind).alias("kind"), rel.alias("relation"), value.alias("value"), (F.lit("") if lang is None else lang).alias("lang"))
        return row.where("iri is not null and value is not null")

    one = lambda c: F.col(f"`{c}`._IRI")
    two = lambda c: (F.get(F.col(c), F.lit(0))["_IRI"], F.get(F.col(c), F.lit(1))["_IRI"])

    def pairs(tag: str, c: str, kind: str, relation: str) -> DataFrame:
        both = read(tag, **{c: _MANY}).select(c, F.posexplode(c).alias("i", "x")).select("i", "x", F.posexplode(c).alias("j", "y")).where("i <> j")
        return out(both, F.col("x._IRI"), kind, relation, F.col("y._IRI"))

    declared = read("Declaration", **{n: _ONE for n in _NAMES})
    parts = [out(declared, one(n), k, "declared", F.lit(k)) for n, k in _NAMES.items()]
    parts += [out(read("SubClassOf", Class=_MANY).where("size(Class) = 2"), two("Class")[0], "class", "super", two("Class")[1]), pairs("EquivalentClasses", "Class", "class", "equiv"), pairs("DisjointClasses", "Class", "class", "disjoint")]
    for p, kind in (("ObjectProperty", "objectProperty"), ("DataProperty", "dataProperty")):
        parts.append(out(read(f"Sub{p}Of", **{p: _MANY}), two(p)[0], kind, "sub", two(p)[1]))
        parts.append(out(read(f"{p}Domain", **{p: _ONE, "Class": _ONE}), one(p), kind, "domain", one("Class")))
        for name, flag in FLAGS.items():
            if kind == "objectProperty" or flag == "functional":
                parts.append(out(read(name + p, **{p: _ONE}), one(p), kind, "flag", F.lit(flag)))
    parts.append(out(read("ObjectPropertyRange", ObjectProperty=_ONE, Class=_ONE), one("ObjectProperty"), "objectProperty", "range", one("Class")))
    parts.append(pairs("InverseObjectProperties", "ObjectProperty", "objectProperty", "inverse"))
    parts.append(out(read("ClassAssertion", Class=_ONE, NamedIndividual=_ONE), one("NamedIndividual"), "individual", "type", one("Class")))
    facts = read("ObjectPropertyAssertion", ObjectProperty=_ONE, NamedIndividual=_MANY)
    parts.append(out(facts, two("NamedIndividual")[0], "individual", "object", two("NamedIndividual")[1], one("ObjectProperty")))
    values = read("DataPropertyAssertion", DataProperty=_ONE, NamedIndividual=_ONE, Literal="struct<_VALUE:string,_datatypeIRI:string>")
    parts.append(out(values, one("NamedIndividual"), "individual", "data", F.col("Literal._VALUE"), F.concat(one("DataProperty"), F.lit("\u0001"), F.coalesce("Literal._datatypeIRI", F.lit("")))))
    notes = read("AnnotationAssertion", AnnotationProperty=_ONE, IRI="string", Literal="struct<_VALUE:string,`_xml:lang`:string>")
    parts.append(out(notes, F.col("IRI"), "annotation", F.when(one("AnnotationProperty") == LABEL, "label").otherwise(one("AnnotationProperty")), F.col("Literal._VALUE"), F.coalesce("Literal.`_xml:lang`", F.lit(""))))
    return reduce(DataFrame.unionByName, parts).distinct()

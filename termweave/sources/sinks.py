"""Egest: the tables as functional, Manchester or Turtle text, as rows with a sort key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.classexpr import functional_text
from termweave.functions.expressions import literal, written_iri
from termweave.model import LABEL, OWL, RDFS, THING, TYPE_IRI, Ontology

DECLARED = {"class": "Class", "objectProperty": "ObjectProperty", "dataProperty": "DataProperty", "annotationProperty": "AnnotationProperty", "individual": "NamedIndividual"}
FLAGS = {"functional": "Functional", "inverseFunctional": "InverseFunctional", "transitive": "Transitive", "symmetric": "Symmetric", "reflexive": "Reflexive", "irreflexive": "Irreflexive", "asymmetric": "Asymmetric"}
#: Turtle names of property edges and flags (fixed values).
EDGES = {"sub": "rdfs:subPropertyOf", "domain": "rdfs:domain", "range": "rdfs:range", "inverse": "owl:inverseOf", "equiv": "owl:equivalentProperty", "disjoint": "owl:propertyDisjointWith"}
FLAG_TYPES = {k: f"owl:{v}Property" for k, v in FLAGS.items()}
FRAME = {"class": "Class", "objectProperty": "ObjectProperty", "dataProperty": "DataProperty", "annotationProperty": "AnnotationProperty", "individual": "Individual"}


def _b(name: str) -> Column:
    return F.concat(F.lit("<"), F.col(name), F.lit(">"))


def _case(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), table.items(), F)


def _axiom(keyword, *parts) -> Column:
    k = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.concat(k, F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))


def axiom_lines(x: Ontology, expressions: bool = True) -> DataFrame:
    """onto_id, iri, section, ord, line: every axiom of every entity in functional syntax.

    Super owl:Thing is left out, a disjoint pair is written once.  Expressions are written from their
    tree, so whatever syntax they are stored in; those that cannot be read are left out, and all with
    expressions=False.
    """
    row = lambda df, iri, section, line, ord_=F.lit(0): df.select("onto_id", F.col(iri).alias("iri"), F.lit(section).alias("section"), ord_.cast("int").alias("ord"), line.alias("line"))
    kind = F.col("kind")
    e = x.class_edge
    object_props = x.entity.where("type = 'objectProperty'").select("onto_id", F.col("iri").alias("prop"), F.lit("Object").alias("_k"))
    data_props = x.entity.where("type = 'dataProperty'").select("onto_id", F.col("iri").alias("prop"), F.lit("Data").alias("_k"))
    props = object_props.unionByName(data_props)
    pe, pf = x.prop_edge.join(props, ["onto_id", "prop"]), x.prop_flag.join(props, ["onto_id", "prop"])
    parts = [
        row(x.entity, "iri", "1declaration", _axiom("Declaration", F.concat(_case(F.col("type"), DECLARED), F.lit("("), _b("iri"), F.lit(")")))),
        row(x.label, "iri", "2annotation", _axiom("AnnotationAssertion", F.lit("rdfs:label"), _b("iri"), literal(F.col("text"), F.col("lang"), F.lit(""))), F.col("ord")),
        row(x.annotation, "iri", "2annotation", _axiom("AnnotationAssertion", written_iri(F.col("prop")), _b("iri"), literal(F.col("text"), F.col("lang"), F.lit(""))), F.col("ord")),
        row(e.where((kind == "sub") & (F.col("sup") != THING)), "sub", "3class", _axiom("SubClassOf", _b("sub"), _b("sup")), F.col("ord")),
        row(e.where(kind == "equiv"), "sub", "3class", _axiom("EquivalentClasses", _b("sub"), _b("sup")), F.col("ord")),
        row(e.where((kind == "disjoint") & (F.col("sub") < F.col("sup"))), "sub", "3class", _axiom("DisjointClasses", _b("sub"), _b("sup")), F.col("ord")),
        row(pe.where(kind == "sub"), "prop", "4property", _axiom(F.concat(F.lit("Sub"), "_k", F.lit("PropertyOf")), _b("prop"), _b("target"))),
        row(pe.where(kind == "domain"), "prop", "4property", _axiom(F.concat("_k", F.lit("PropertyDomain")), _b("prop"), _b("target"))),
        row(pe.where(kind == "range"), "prop", "4property", _axiom(F.concat("_k", F.lit("PropertyRange")), _b("prop"), _b("target"))),
        row(pe.where((kind == "inverse")), "prop", "4property", _axiom("InverseObjectProperties", _b("prop"), _b("target"))),
        row(pe.where(kind == "equiv"), "prop", "4property", _axiom(F.concat(F.lit("Equivalent"), "_k", F.lit("Properties")), _b("prop"), _b("target"))),
        row(pe.where((kind == "disjoint") & (F.col("prop") < F.col("target"))), "prop", "4property", _axiom(F.concat(F.lit("Disjoint"), "_k", F.lit("Properties")), _b("prop"), _b("target"))),
        row(pf.where(F.col("flag").isin(*FLAGS)), "prop", "4property", _axiom(F.concat(_case(F.col("flag"), FLAGS), "_k", F.lit("Property")), _b("prop"))),
        row(x.prop_chain, "prop", "7chain", _axiom("SubObjectPropertyOf", _axiom("ObjectPropertyChain", F.array_join(F.transform("members", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), " ")), _b("prop")), F.col("chain_no")),
        row(x.type_assert, "ind", "5individual", _axiom("ClassAssertion", _b("class"), _b("ind"))),
        row(x.obj_assert, "ind", "5individual", _axiom("ObjectPropertyAssertion", _b("prop"), _b("ind"), _b("target"))),
        row(x.data_assert, "ind", "5individual", _axiom("DataPropertyAssertion", _b("prop"), _b("ind"), literal(F.col("value"), F.lit(""), F.col("datatype")))),
    ]
    if expressions:
        said = x.class_expr.join(functional_text(x.class_expr), "expr").where("functional is not null")
        body = F.col("functional")
        line = F.when(F.col("role") == "gci", _axiom("SubClassOf", body, _b("iri"))).when(F.col("role") == "equiv", _axiom("EquivalentClasses", _b("iri"), body)).otherwise(_axiom("SubClassOf", _b("iri"), body))
        parts.append(said.select("onto_id", "iri", F.when(F.col("role") == "gci", "6gci").otherwise("3class").alias("section"), F.col("ord").cast("int").alias("ord"), line.alias("line")))
    return reduce(DataFrame.unionByName, parts).distinct()


def functional_document(x: Ontology, iri: str, prefixes: dict[str, str] | None = None, expressions: bool = False) -> DataFrame:
    """onto_id, section, kind_rank, iri, ord, line of a whole document, to be written in that order."""
    rank = _case(F.col("type"), {k: str(i) for i, k in enumerate(DECLARED)})
    kinds = x.entity.groupBy("onto_id", "iri").agg(F.min(rank).alias("kind_rank"))
    body = axiom_lines(x, expressions).join(kinds, ["onto_id", "iri"], "left")
    body = body.select("onto_id", "section", F.coalesce("kind_rank", F.lit("9")).alias("kind_rank"), "iri", "ord", "line")
    ids = x.entity.select("onto_id").distinct()
    own = {"owl": OWL, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "": iri, **(prefixes or {})}
    head = [f"Prefix({k}:=<{v}>)" for k, v in sorted(own.items())] + ["", f"Ontology(<{iri}>"]
    first = ids.select("onto_id", F.lit("0head").alias("section"), F.lit("").alias("kind_rank"), F.lit("").alias("iri"), F.posexplode(F.array(*map(F.lit, head))).alias("ord", "line"))
    last = ids.select("onto_id", F.lit("9end").alias("section"), F.lit("").alias("kind_rank"), F.lit("").alias("iri"), F.lit(0).alias("ord"), F.lit(")").alias("line"))
    return first.unionByName(body).unionByName(last)


def write_functional(x: Ontology, iri: str, path: str, expressions: bool = True) -> None:
    """K01 to text files in order (their names sort as their lines do), one ontology's document after another."""
    functional_document(x, iri, None, expressions).orderBy("onto_id", "section", "kind_rank", "iri", "ord", "line").select("line").write.text(path)


#: Section names of property edges and flags in Manchester frames (fixed values).
SECTIONS = {"sub": "SubPropertyOf", "domain": "Domain", "range": "Range", "inverse": "InverseOf", "equiv": "EquivalentTo", "disjoint": "DisjointWith"}


def manchester_sections(x: Ontology) -> DataFrame:
    """onto_id, iri, frame, section, items: comma-joined items of each frame section."""
    row = lambda d, iri, section, item: d.select("onto_id", F.col(iri).alias("iri"), (F.lit(section) if isinstance(section, str) else section).alias("section"), item.alias("item"))
    e = x.class_edge.where(~((F.col("kind") == "sub") & (F.col("sup") == THING)))
    name = _case(F.col("kind"), {"sub": "SubClassOf", "equiv": "EquivalentTo", "disjoint": "DisjointWith"})
    text = lambda prop, dt=F.lit(""): F.concat(written_iri(prop), F.lit(" "), literal(F.col("text"), F.col("lang"), dt))
    items = [
        row(e, "sub", name, _b("sup")),
        row(x.class_expr.where("role in ('super', 'equiv')"), "iri", F.when(F.col("role") == "super", "SubClassOf").otherwise("EquivalentTo"), F.col("expr")),
        row(x.type_assert, "ind", "Types", _b("class")),
        row(x.obj_assert, "ind", "Facts", F.concat_ws(" ", _b("prop"), _b("target"))),
        row(x.data_assert, "ind", "Facts", F.concat_ws(" ", _b("prop"), literal(F.col("value"), F.lit(""), F.col("datatype")))),
        row(x.label, "iri", "Annotations", text(F.lit(LABEL))),
        row(x.annotation, "iri", "Annotations", text(F.col("prop"))),
        row(x.prop_edge.where(F.col("kind").isin(*SECTIONS)), "prop", _case(F.col("kind"), SECTIONS), _b("target")),
        row(x.prop_flag.where(F.col("flag").isin(*FLAGS)), "prop", "Characteristics", _case(F.col("flag"), FLAGS)),
        row(x.prop_chain, "prop", "SubPropertyChain", F.array_join(F.transform("members", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), " o ")),
    ]
    rows = reduce(DataFrame.unionByName, items).groupBy("onto_id", "iri", "section").agg(F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("items"))
    kinds = x.entity.groupBy("onto_id", "iri").agg(F.min_by("type", _case(F.col("type"), {k: str(i) for i, k in enumerate(FRAME)})).alias("type"))
    return rows.join(kinds, ["onto_id", "iri"]).select("onto_id", "iri", _case(F.col("type"), FRAME).alias("frame"), "section", "items")


def manchester_lines(x: Ontology) -> DataFrame:
    """onto_id, iri, ord, line: frames of Manchester text, also of entities without a section."""
    s = manchester_sections(x)
    kinds = x.entity.groupBy("onto_id", "iri").agg(F.min_by("type", _case(F.col("type"), {k: str(i) for i, k in enumerate(FRAME)})).alias("type"))
    head = kinds.select("onto_id", "iri", F.lit(0).alias("ord"), F.concat(_case(F.col("type"), FRAME), F.lit(": "), _b("iri")).alias("line"))
    return head.unionByName(s.select("onto_id", "iri", F.lit(1).alias("ord"), F.concat(F.lit("    "), "section", F.lit(": "), "items").alias("line")))


def write_manchester(x: Ontology, path: str) -> None:
    """K03 to text files in order; a frame is never in two of them."""
    manchester_lines(x).repartitionByRange("onto_id", "iri").sortWithinPartitions("onto_id", "iri", "ord", "line").select("line").write.text(path)


def turtle_lines(x: Ontology) -> DataFrame:
    """onto_id, iri, line: a Turtle statement for each entity, its predicates in order; expressions are left out."""
    a = x.entity.select("onto_id", "iri", F.concat(F.lit("a <"), _case(F.col("type"), TYPE_IRI), F.lit(">")).alias("seg"), F.lit("0").alias("k"))
    name = _case(F.col("kind"), {"sub": "rdfs:subClassOf", "equiv": "owl:equivalentClass", "disjoint": "owl:disjointWith"})
    e = x.class_edge.where(~((F.col("kind") == "sub") & (F.col("sup") == THING))).select("onto_id", F.col("sub").alias("iri"), F.concat(name, F.lit(" "), _b("sup")).alias("seg"), F.lit("1").alias("k"))
    lab = x.label.select("onto_id", "iri", F.concat(F.lit("rdfs:label "), literal(F.col("text"), F.col("lang"), F.lit(""))).alias("seg"), F.lit("2").alias("k"))
    ann = x.annotation.where(F.col("prop") != LABEL).select("onto_id", "iri", F.concat(written_iri(F.col("prop")), F.lit(" "), literal(F.col("text"), F.col("lang"), F.lit(""))).alias("seg"), F.lit("3").alias("k"))
    typ = x.type_assert.select("onto_id", F.col("ind").alias("iri"), F.concat(F.lit("a "), _b("class")).alias("seg"), F.lit("1").alias("k"))
    obj = x.obj_assert.select("onto_id", F.col("ind").alias("iri"), F.concat(_b("prop"), F.lit(" "), _b("target")).alias("seg"), F.lit("4").alias("k"))
    val = x.data_assert.select("onto_id", F.col("ind").alias("iri"), F.concat(_b("prop"), F.lit(" "), literal(F.col("value"), F.lit(""), F.col("datatype"))).alias("seg"), F.lit("5").alias("k"))
    seg = lambda d, k, text: d.select("onto_id", F.col("prop").alias("iri"), text.alias("seg"), F.lit(k).alias("k"))
    flag = seg(x.prop_flag.where(F.col("flag").isin(*FLAG_TYPES)), "0", F.concat(F.lit("a "), _case(F.col("flag"), FLAG_TYPES)))
    edge = seg(x.prop_edge.where(F.col("kind").isin(*EDGES)), "1", F.concat(_case(F.col("kind"), EDGES), F.lit(" "), _b("target")))
    chain = seg(x.prop_chain, "1", F.concat(F.lit("owl:propertyChainAxiom ( "), F.array_join(F.transform("members", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), " "), F.lit(" )")))
    rows = reduce(DataFrame.unionByName, [a, e, lab, ann, typ, obj, val, flag, edge, chain]).groupBy("onto_id", "iri").agg(F.array_sort(F.collect_set(F.struct("k", "seg"))).alias("p"))
    return rows.select("onto_id", "iri", F.concat(_b("iri"), F.lit(" "), F.array_join("p.seg", " ; "), F.lit(" .")).alias("line"))


#: Prefixes of the names that turtle_lines() writes short (fixed values).
TURTLE_HEAD = [f"@prefix {k}: <{v}> ." for k, v in (("owl", OWL), ("rdfs", RDFS))]


def write_turtle(x: Ontology, path: str) -> None:
    """K04 to text files, each ontology's statements in order; every file starts with the prefixes it needs."""
    head = "\n".join(TURTLE_HEAD)
    rows = turtle_lines(x).repartitionByRange("onto_id", "iri").sortWithinPartitions("onto_id", "iri")
    own = rows.withColumn("n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    own.select(F.when(F.col("n") == 0, F.concat(F.lit(head + "\n"), "line")).otherwise(F.col("line")).alias("line")).write.text(path)


def ntriples_lines(t: DataFrame) -> DataFrame:
    """onto_id, line: triples (S13's columns) as N-Triples; blank nodes by their own names."""
    term = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.replace(F.replace(literal(F.col("o"), F.col("o_lang"), F.col("o_dt")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return t.select("onto_id", F.concat_ws(" ", term(F.col("s")), term(F.col("p")), F.when(F.col("o_kind") == "lit", text).otherwise(term(F.col("o"))), F.lit(".")).alias("line"))

"""Ontologies as tables: names, term keys, and the tables of FIXTURES derived from relational data.

A term key is one string for a term (kind, value, language, datatype), so that graph patterns join by
plain equality; the parts come back by splitting it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.plans.tables import spread

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE, SUB, LABEL = RDF + "type", RDFS + "subClassOf", RDFS + "label"
THING, NOTHING = OWL + "Thing", OWL + "Nothing"
BASE = "http://b.example/"
SEP = "\u0001"
KIND_ORDER = ["class", "objectProperty", "dataProperty", "annotationProperty", "individual"]
TYPE_IRI = {"class": OWL + "Class", "objectProperty": OWL + "ObjectProperty", "dataProperty": OWL + "DatatypeProperty", "annotationProperty": OWL + "AnnotationProperty", "individual": OWL + "NamedIndividual"}
#: Annotation properties that every ontology has (fixed values).
BUILT_IN = [RDFS + x for x in ("label", "comment", "seeAlso", "isDefinedBy")] + [OWL + x for x in ("versionInfo", "deprecated", "backwardCompatibleWith", "incompatibleWith", "priorVersion")] + [SKOS + x for x in ("prefLabel", "altLabel", "hiddenLabel", "definition", "note", "example", "scopeNote", "editorialNote", "historyNote")]


def term_key(kind, value, lang=None, dt=None) -> Column:
    """kind, value, language and datatype in one string; xsd:string and no datatype are the same."""
    part = lambda x: F.coalesce(x, F.lit("")) if isinstance(x, Column) else F.lit(x or "")
    dt = part(dt)
    return F.concat(part(kind), F.lit(SEP), part(value), F.lit(SEP), part(lang), F.lit(SEP), F.when(dt == XSD + "string", "").otherwise(dt))


def iri_key(value) -> Column:
    return term_key("iri", value)


def _part(n: int):
    return lambda key: F.split_part(key, F.lit(SEP), F.lit(n))


kind_of, value_of, lang_of, dt_of = _part(1), _part(2), _part(3), _part(4)


def is_named(c: Column) -> Column:
    return c.rlike("^(http|urn|file)")


def local_name(c: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(c, "[^#/]*$", 0)


def iri(kind: str, key) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), key if isinstance(key, Column) else F.col(key).cast("string"))


@dataclass
class Ontology:
    """The tables of one or many ontologies; every table starts with onto_id."""

    entity: DataFrame
    label: DataFrame
    annotation: DataFrame
    class_edge: DataFrame
    class_expr: DataFrame
    prop_edge: DataFrame
    prop_flag: DataFrame
    prop_chain: DataFrame
    type_assert: DataFrame
    obj_assert: DataFrame
    data_assert: DataFrame


SCHEMAS = {
    "entity": "onto_id string, iri string, type string",
    "label": "onto_id string, iri string, lang string, ord int, text string",
    "annotation": "onto_id string, iri string, prop string, ord int, raw string, text string, lang string",
    "class_edge": "onto_id string, sub string, sup string, kind string, ord int",
    "class_expr": "onto_id string, iri string, role string, ord int, expr string",
    "prop_edge": "onto_id string, prop string, target string, kind string",
    "prop_flag": "onto_id string, prop string, flag string",
    "prop_chain": "onto_id string, prop string, chain_no int, members array<string>",
    "type_assert": "onto_id string, ind string, class string",
    "obj_assert": "onto_id string, ind string, prop string, target string",
    "data_assert": "onto_id string, ind string, prop string, value string, datatype string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A few constant rows, without Python in the plan."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else ("array(" + ", ".join(map(quote, v)) + ")") if isinstance(v, list) else "'" + v.replace("'", "\\'") + "'"
    cols = [c.split() for c in SCHEMAS[name].split(", ")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) {c}" for c, t in cols) + " WHERE false")
    body = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return spark.sql("SELECT " + ", ".join(f"CAST({c} AS {t}) {c}" for c, t in cols) + f" FROM VALUES {body} AS t({', '.join(c for c, _ in cols)})")


def derive(spark: SparkSession, sf_dir: str, onto: str = "shop", lines: bool = True) -> Ontology:
    """The relational tables as an ontology: region, nation, customer, order and line classes, parts as individuals."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem", "part", "documents")}
    o = F.lit(onto).alias("onto_id")
    line = iri("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    ent = lambda df, c, kind: df.select(o, c.alias("iri"), F.lit(kind).alias("type"))
    edge = lambda df, a, b: df.select(o, a.alias("sub"), b.alias("sup"), F.lit("sub").alias("kind"), F.lit(0).alias("ord"))
    lab = lambda df, c, text, lang="en": df.select(o, c.alias("iri"), F.lit(lang).alias("lang") if isinstance(lang, str) else lang.alias("lang"), F.lit(0).alias("ord"), text.alias("text"))
    every = lambda parts: parts[0] if len(parts) == 1 else every([parts[0].unionByName(parts[1]), *parts[2:]])
    ptype, brand = iri("ptype", "p_type"), iri("brand", "p_brand")
    props = [(onto, BASE + "hasPart", "objectProperty"), (onto, BASE + "partOf", "objectProperty"), (onto, BASE + "madeOf", "objectProperty"), (onto, BASE + "acctbal", "dataProperty"), (onto, BASE + "size", "dataProperty"), (onto, BASE + "segment", "annotationProperty")]
    entity = [ent(t["region"], iri("region", "r_regionkey"), "class"), ent(t["nation"], iri("nation", "n_nationkey"), "class"), ent(t["customer"], iri("customer", "c_custkey"), "class"), ent(t["orders"], iri("order", "o_orderkey"), "class"), ent(t["part"].select("p_type").distinct(), ptype, "class"), ent(t["part"].select("p_brand").distinct(), brand, "class"), ent(t["part"], iri("part", "p_partkey"), "individual"), _values(spark, "entity", props)]
    edges = [edge(t["region"], iri("region", "r_regionkey"), F.lit(THING)), edge(t["nation"], iri("nation", "n_nationkey"), iri("region", "n_regionkey")), edge(t["customer"], iri("customer", "c_custkey"), iri("nation", "c_nationkey")), edge(t["orders"], iri("order", "o_orderkey"), iri("customer", "o_custkey"))]
    exprs = _values(spark, "class_expr", [])
    if lines:
        key = ("l_orderkey", "l_linenumber")
        each = spread(t["lineitem"].select(*key, "l_partkey"), t["lineitem"].count(), *key)
        own = each.select(*key).distinct()
        entity.append(ent(own, line, "class"))
        edges.append(edge(own, line, iri("order", "l_orderkey")))
        some = each.distinct()
        exprs = some.select(o, line.alias("iri"), F.lit("super").alias("role"), F.lit(0).alias("ord"), F.concat(F.lit(f"{BASE}hasPart some {BASE}part/"), F.col("l_partkey").cast("string")).alias("expr"))
    text = F.concat(F.col("c_mktsegment"), F.lit("@en"))
    return Ontology(
        entity=every(entity),
        label=every([lab(t["region"], iri("region", "r_regionkey"), F.col("r_name")), lab(t["nation"], iri("nation", "n_nationkey"), F.col("n_name")), lab(t["customer"], iri("customer", "c_custkey"), F.col("c_name")), lab(t["part"], iri("part", "p_partkey"), F.col("p_name")), lab(t["documents"].where("text is not null"), iri("document", "doc_id"), F.col("text"), F.col("lang"))]),
        annotation=every([t["customer"].select(o, iri("customer", "c_custkey").alias("iri"), F.lit(BASE + "segment").alias("prop"), F.lit(0).alias("ord"), text.alias("raw"), F.col("c_mktsegment").alias("text"), F.lit("en").alias("lang")), t["part"].select(o, iri("part", "p_partkey").alias("iri"), F.lit(SKOS + "altLabel").alias("prop"), F.lit(0).alias("ord"), F.col("p_brand").alias("raw"), F.col("p_brand").alias("text"), F.lit("").alias("lang"))]),
        class_edge=every(edges),
        class_expr=exprs,
        prop_edge=_values(spark, "prop_edge", [(onto, BASE + "hasPart", BASE + "partOf", "inverse"), (onto, BASE + "madeOf", BASE + "hasPart", "sub"), (onto, BASE + "hasPart", BASE + "region/0", "domain")]),
        prop_flag=_values(spark, "prop_flag", [(onto, BASE + "hasPart", "transitive"), (onto, BASE + "acctbal", "functional")]),
        prop_chain=_values(spark, "prop_chain", [(onto, BASE + "hasPart", 0, [BASE + "hasPart", BASE + "madeOf"])]),
        type_assert=every([t["part"].select(o, iri("part", "p_partkey").alias("ind"), ptype.alias("class")), t["part"].select(o, iri("part", "p_partkey").alias("ind"), brand.alias("class"))]),
        obj_assert=table(spark, sf_dir, "supplier").select(o, iri("supplier", "s_suppkey").alias("ind"), F.lit(BASE + "locatedIn").alias("prop"), iri("nation", "s_nationkey").alias("target")),
        data_assert=every([t["customer"].select(o, iri("customer", "c_custkey").alias("ind"), F.lit(BASE + "acctbal").alias("prop"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("value"), F.lit(XSD + "decimal").alias("datatype")), t["part"].select(o, iri("part", "p_partkey").alias("ind"), F.lit(BASE + "size").alias("prop"), F.col("p_size").cast("string").alias("value"), F.lit(XSD + "integer").alias("datatype"))]),
    )

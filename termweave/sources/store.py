"""The tables of an ontology as a set of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.model import LABEL, OWL, RDFS, SUB, TYPE, TYPE_IRI, Ontology
from termweave.operators.patterns import triple_row

EDGE = {"sub": SUB, "equiv": OWL + "equivalentClass", "disjoint": OWL + "disjointWith"}
PROP = {"sub": RDFS + "subPropertyOf", "domain": RDFS + "domain", "range": RDFS + "range", "inverse": OWL + "inverseOf"}
#: Flags that the store writes, and those it leaves out (reflexive, irreflexive, asymmetric).
FLAG = {"transitive": OWL + "TransitiveProperty", "symmetric": OWL + "SymmetricProperty", "functional": OWL + "FunctionalProperty", "inverseFunctional": OWL + "InverseFunctionalProperty"}


def lookup(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), table.items(), F)


def triples(x: Ontology, distinct: bool = True) -> DataFrame:
    """onto_id, s, p, o_kind, o, o_lang, o_dt, o_key.

    Labels and annotations keep their language (an annotation is a proper literal, not its raw text);
    class expressions, general axioms, chains and inferred edges are not written, nor individuals'
    kind.  Data properties have no functional flag.  Without distinct the pass for duplicates is left
    out: tables without repeated rows need none, and a pattern's constants then reach the base tables.
    """
    rows = lambda df, *a: df.select("onto_id", *triple_row(*a))
    c = F.col
    kinds = x.entity.where(c("type") != "individual")
    data_props = x.entity.where(c("type") == "dataProperty").select("onto_id", c("iri").alias("prop"))
    parts = [
        rows(kinds, c("iri"), TYPE, "iri", lookup(c("type"), TYPE_IRI)),
        rows(x.class_edge.where(c("kind").isin(*EDGE)), c("sub"), lookup(c("kind"), EDGE), "iri", c("sup")),
        rows(x.prop_edge.where(c("kind").isin(*PROP)), c("prop"), lookup(c("kind"), PROP), "iri", c("target")),
        rows(x.prop_flag.where(c("flag").isin(*FLAG)).join(data_props, ["onto_id", "prop"], "left_anti"), c("prop"), TYPE, "iri", lookup(c("flag"), FLAG)),
        rows(x.type_assert, c("ind"), TYPE, "iri", c("class")),
        rows(x.obj_assert, c("ind"), c("prop"), "iri", c("target")),
        rows(x.data_assert, c("ind"), c("prop"), "lit", c("value"), F.lit(""), F.coalesce("datatype", F.lit(""))),
        rows(x.label, c("iri"), LABEL, "lit", c("text"), F.coalesce("lang", F.lit(""))),
        rows(x.annotation, c("iri"), c("prop"), "lit", c("text"), F.coalesce("lang", F.lit(""))),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.dropDuplicates() if distinct else out


def write(df: DataFrame, path: str) -> None:
    """The triples as Parquet, a folder for each predicate, so that a pattern's predicate prunes the scan.

    Every task writes what it has, so tasks grow in number with the triples and nothing is shuffled.
    """
    df.write.partitionBy("p").parquet(path)

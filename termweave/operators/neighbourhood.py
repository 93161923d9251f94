"""Neighbourhood graphs of many foci at once: start sets, expansion by hops, edges, nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.model import THING, Ontology, local_name
from termweave.operators.search import kinds
from termweave.plans.tables import save, spread

MAX_NODES = 200


def start_set(x: Ontology, most: int = MAX_NODES, few: int = 20) -> DataFrame:
    """onto_id, iri without a focus: all classes if they are at most `most`, else those under owl:Thing, else the first few."""
    classes = x.entity.where("type = 'class'").select("onto_id", "iri").distinct()
    n = classes.groupBy("onto_id").agg(F.count("*").alias("n"))
    top = x.class_edge.where((F.col("kind") == "sub") & (F.col("sup") == THING)).select("onto_id", F.col("sub").alias("iri")).distinct()
    large = n.where(F.col("n") > most).select("onto_id")
    small = classes.join(n.where(F.col("n") <= most).select("onto_id"), "onto_id", "left_semi")
    under = top.join(large, "onto_id", "left_semi")
    rest = classes.join(large, "onto_id", "left_semi").join(under.select("onto_id").distinct(), "onto_id", "left_anti")
    first = rest.withColumn("r", F.row_number().over(W.partitionBy("onto_id").orderBy("iri"))).where(F.col("r") <= few).drop("r")
    return small.unionByName(under).unionByName(first)


def steps(x: Ontology, inferred: DataFrame | None = None, disjoint: bool = False) -> DataFrame:
    """onto_id, at, to, id, source, target, type, is_inferred: every step that the expansion may take.

    N03: directed edges are named by their ends, symmetric ones by their ends in order; an inferred
    edge is left out where the asserted one exists.
    """
    def rows(df, a, b, kind, code, both, inf=False, symmetric=False):
        a, b = F.col(a), F.col(b)
        pair = F.concat_ws(f"|{code}|", F.least(a, b), F.greatest(a, b)) if symmetric else F.concat_ws(f"|{code}|", a, b)
        base = df.select("onto_id", pair.alias("id"), a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(inf).alias("is_inferred"))
        out = base.withColumn("at", F.col("source")).withColumn("to", F.col("target"))
        return out.unionByName(base.withColumn("at", F.col("target")).withColumn("to", F.col("source"))) if both else out

    sub = x.class_edge.where((F.col("kind") == "sub") & (F.col("sup") != THING)).select("onto_id", "sub", "sup").distinct()
    parts = [rows(sub, "sub", "sup", "subClassOf", "sub", True)]
    symmetric = lambda kind: x.class_edge.where(F.col("kind") == kind).select("onto_id", F.least("sub", "sup").alias("sub"), F.greatest("sub", "sup").alias("sup")).distinct()
    parts.append(rows(symmetric("equiv"), "sub", "sup", "equivalentTo", "eq", True, symmetric=True))
    if disjoint:
        parts.append(rows(symmetric("disjoint"), "sub", "sup", "disjointWith", "dis", True, symmetric=True))
    if inferred is not None:
        inf = inferred.select("onto_id", F.col("child").alias("sub"), F.col("parent").alias("sup")).distinct().join(sub, ["onto_id", "sub", "sup"], "left_anti")
        parts.append(rows(inf, "sub", "sup", "inferred", "inf", False, True).withColumn("at", F.col("target")).withColumn("to", F.col("source")))
    for kind, code in (("domain", "dom"), ("range", "rng"), ("sub", "sprop")):
        parts.append(rows(x.prop_edge.where(F.col("kind") == kind), "prop", "target", {"sub": "subPropertyOf"}.get(kind, kind), code, False))
    parts.append(rows(x.type_assert, "ind", "class", "type", "type", False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGE = ["onto_id", "focus", "id", "source", "target", "type", "is_inferred"]


def expand(foci: DataFrame, step: DataFrame, depth: int, most: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes: onto_id, focus, iri, hop; edges: onto_id, focus, id, source, target, type, is_inferred).

    A focus keeps its first `most` nodes by hop and IRI.  The cap is the feature: a graph is drawn of it.
    """
    nodes, edges, _ = _walks(foci, step, depth, most)
    return nodes, edges.distinct()  # an edge's id tells its other columns


def _walks(foci: DataFrame, step: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The nodes, the edges as often as they were walked, and how many walks there were."""
    nodes = foci.select("onto_id", "focus", F.col("focus").alias("iri"), F.lit(0).alias("hop")).distinct()
    frontier, edges, walks = nodes, None, 0
    for hop in range(1, depth + 1):
        walked = save(frontier.select("onto_id", "focus", F.col("iri").alias("at")).join(step, ["onto_id", "at"]), "walked")
        walks += walked.count()
        edges = walked.drop("at", "to") if edges is None else edges.unionByName(walked.drop("at", "to"))
        new = walked.select("onto_id", "focus", F.col("to").alias("iri")).distinct().join(nodes, ["onto_id", "focus", "iri"], "left_anti").withColumn("hop", F.lit(hop))
        rank = F.row_number().over(W.partitionBy("onto_id", "focus").orderBy("hop", "iri"))
        nodes = save(nodes.unionByName(new).withColumn("_r", rank).where(F.col("_r") <= most).drop("_r"), "nodes")
        frontier = nodes.where(F.col("hop") == hop)
    if edges is None:
        edges = foci.join(step, ["onto_id"]).where(F.lit(False)).drop("at", "to")
    return nodes, edges.select(*EDGE), walks


def induced(nodes: DataFrame, step: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """Class edges among the nodes of foci that stayed under the cap."""
    room = nodes.groupBy("onto_id", "focus").agg(F.count("*").alias("n")).where(F.col("n") < most).select("onto_id", "focus")
    own = nodes.join(room, ["onto_id", "focus"], "left_semi").select("onto_id", "focus", "iri")
    # each edge once, by its source, and only those of nodes: most edges of an ontology are not near a focus
    edges = step.where(F.col("type").isin("subClassOf", "equivalentTo", "disjointWith") & (F.col("at") == F.col("source")))
    edges = edges.join(own.select("onto_id", F.col("iri").alias("source")).distinct(), ["onto_id", "source"], "left_semi").select("onto_id", "id", "source", "target", "type", "is_inferred").distinct()
    some = own.withColumnRenamed("iri", "source").join(edges, ["onto_id", "source"])
    return some.join(own.withColumnRenamed("iri", "target"), ["onto_id", "focus", "target"], "left_semi").select("onto_id", "focus", "id", "source", "target", "type", "is_inferred")


def node_table(nodes: DataFrame, x: Ontology, labels: DataFrame) -> DataFrame:
    """Nodes with label, type and is_root; what is not declared is a class named by its local name."""
    out = nodes.join(kinds(x), ["onto_id", "iri"], "left").join(labels, ["onto_id", "iri"], "left")
    return out.select("onto_id", "focus", "iri", "hop", F.coalesce("label", local_name(F.col("iri"))).alias("label"), F.coalesce("type", F.lit("class")).alias("type"), (F.col("iri") == F.col("focus")).alias("is_root"))


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select("onto_id", "focus", F.col("iri").alias(end)), ["onto_id", "focus", end], "left_semi")
    return edges


def graph(foci: DataFrame, x: Ontology, labels: DataFrame, depth: int = 1, most: int = MAX_NODES, inferred: DataFrame | None = None, disjoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the neighbourhoods."""
    step = steps(x, inferred, disjoint)
    nodes, edges, walks = _walks(foci, step, depth, most)
    edges = spread(edges.unionByName(induced(nodes, step, most)), 2 * walks, "onto_id", "focus", "source").distinct()
    return node_table(nodes, x, labels), closed(edges, nodes)

"""An ontology from one syntax to another: a scan to tables, the tables to a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.model import Ontology
from termweave.sources import scans as S
from termweave.sources import sinks as K
from termweave.sources import store, turtle
from termweave.sources import tables as T

READS = ("functional", "manchester", "turtle", "rdf-xml", "owl-xml")
WRITES = ("functional", "manchester", "turtle", "ntriples")


def format_of(spark: SparkSession, path: str) -> str:
    """The format of the first lines of a path's first file, by S09; by its extension (S10) if they tell nothing."""
    start = spark.read.text(path).limit(200).select("value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("path"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")
    row = start.agg(S.content_format(text).alias("told"), S.path_format(F.min("path")).alias("named")).head()
    return row["named"] if row["told"] == "unknown" else row["told"]


def read(spark: SparkSession, path: str, syntax: str | None = None, onto_id: Column | None = None, base: str = "") -> Ontology:
    """The tables of all files of a path, in one syntax (found from the text if not told).

    An ontology is a file, or what onto_id says; XML needs onto_id.  Prefixes hold for their file.
    """
    syntax = syntax or format_of(spark, path)
    if syntax == "functional":
        return T.from_axioms(S.functional_axioms(spark, path), onto_id)
    if syntax == "manchester":
        raw = S.lines(spark, path)
        return T.from_manchester(S.manchester(S.joined_lines(raw)), onto_id, S.prefixes(raw))
    if syntax == "turtle":
        return T.from_triples(turtle.triples(spark, path, onto_id))
    if syntax in ("rdf-xml", "owl-xml"):
        rows = T.rdfxml(spark, path, base) if syntax == "rdf-xml" else T.owlxml(spark, path)
        return T.from_relations(rows, F.lit(path) if onto_id is None else onto_id)
    raise ValueError(f"no reader of {syntax}; there are {', '.join(READS)}")


def write(x: Ontology, path: str, syntax: str, iri: str = "") -> None:
    """The tables as text files of one syntax; what it cannot say is left out: Turtle has no expressions, frames no general axioms."""
    writers = {
        "functional": lambda: K.write_functional(x, iri, path),
        "manchester": lambda: K.write_manchester(x, path),
        "turtle": lambda: K.write_turtle(x, path),
        "ntriples": lambda: _text(K.ntriples_lines(store.triples(x)), path),
    }
    if syntax not in writers:
        raise ValueError(f"no writer of {syntax}; there are {', '.join(WRITES)}")
    writers[syntax]()


def _text(rows: DataFrame, path: str) -> None:
    rows.select("line").write.text(path)


def convert(spark: SparkSession, source: str, target: str, to: str, syntax: str | None = None, iri: str = "") -> Ontology:
    """Read source, write target in the syntax `to`; gives the tables in between."""
    x = read(spark, source, syntax, F.lit(iri or source))
    write(x, target, to, iri)
    return x

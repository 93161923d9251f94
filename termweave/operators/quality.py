"""Data-quality checks over entities, references and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import expressions as X
from termweave.model import BUILT_IN, OWL, Ontology
from termweave.operators.search import mentions


def validation(rows: DataFrame) -> DataFrame:
    """Id, message for every (id, expr), expr normalised, that is incomplete or else has an unknown reference."""
    e = F.col("expr")
    message = F.when(X.incomplete(e), "Incomplete expression").when(X.unresolved(e), "Unknown entity reference")
    return rows.select("id", message.alias("message")).where("message is not null")


def undeclared(x: Ontology) -> DataFrame:
    """onto_id, iri that some axiom mentions and no declaration names; built-in names aside."""
    refs = mentions(x).select("onto_id", F.col("ref").alias("iri")).distinct().where(~F.col("iri").startswith(OWL) & ~F.col("iri").isin(*BUILT_IN))
    return refs.join(x.entity, ["onto_id", "iri"], "left_anti")


def unlabelled(x: Ontology) -> DataFrame:
    """onto_id, iri, type of entities without a label."""
    return x.entity.join(x.label.select("onto_id", "iri"), ["onto_id", "iri"], "left_anti")

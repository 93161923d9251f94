"""Corpus pipeline: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import stages
from termweave.llm.common import save

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("minhash_near_dedup", stages.drop_near_duplicates),
    ("personal_data", stages.redact_personal_data),
    ("source_mixing", stages.mix_sources),
    ("best_fit_packing", stages.pack_sequences),
]
#: The trained stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

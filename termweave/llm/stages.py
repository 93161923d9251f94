"""Pipeline stages over a table of documents; all but the last keep its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, neardup, packing, pii, quality
from .common import save
from .queries import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject.

    Every row is judged by its text alone, null ones as empty; null ids, repeated rows and other
    columns stay as they are; an empty table gives an empty one.
    """
    scored = quality.score(docs, table(spark, sf_dir, "labels"), keep_row=True)
    return scored.where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8); null ids and empty texts stay.

    Of rows of one id with equal texts one stays; rows of one id with different texts are judged each.
    """
    key = "_key"
    while key in docs.columns:
        key = "_" + key
    told = docs.withColumn(key, F.xxhash64("text"))
    found = neardup.near_duplicates(told, carry=(key,))
    gone = save(found.where("not kept").select("doc_id", key).distinct(), "gone")
    many = save(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    gone = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_ROWS else gone  # checked; else shuffled
    left = told.join(gone, ["doc_id", key], "left_anti").select(*docs.columns)
    if many.isEmpty():
        return left
    once = left.join(many, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null texts, ids, repeated rows and other columns stay as they are."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so rows without a word go; a null source is a source of its own."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = save(rows, "numbered")  # once: the ids depend on how the scan is cut
    taken = mixing.mix(rows.select("at", "row.doc_id", "row.text", "row.source"), carry=("at",)).where("copies > 0").select("at", "copies")
    both = rows.join(taken, "at").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return both.select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a row without text is a piece of the end id alone."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))

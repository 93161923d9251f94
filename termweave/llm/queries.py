"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, share=(85, 100))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.scan(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chat(rows.withColumn("parts", chat.text_parts("text"))))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.top_k(table(spark, sf_dir, "embeddings")).drop("evaluated")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(table(spark, sf_dir, "documents"))


def op11_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op12_ns_bounds_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import clusters

    return clusters.assign(table(spark, sf_dir, "embeddings")).drop("evaluated")


def op13_era_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import chat, clusters, licences, phrases, vectors

    return {
        "op5_license_digests": licences.scan_sql(),
        "op7_chat_format": chat.DIGEST_SQL,
        "op8_exact_top_k": vectors.TOP_K_SQL,
        "op12_ns_bounds_clusters": clusters.ASSIGN_SQL,
        "op13_era_phrases": phrases.COLLOCATIONS_SQL,
    }

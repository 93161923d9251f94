"""Mixing with about as many sources as documents."""

import os
import uuid

from pyspark.sql import functions as F

from termweave.llm import mixing


def test_mix_buckets_stay_bounded_with_many_sources(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET", 32)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("w " * 5).alias("text"), F.when(F.col("id") < 700, F.col("id")).otherwise(F.col("id") % 5 + 2000).cast("string").alias("source"))
    seen, plain = str(tmp_path), mixing.settler

    def spied(*args):
        settle = plain(*args)

        def run(rows):
            open(os.path.join(seen, f"{len(rows)}-{uuid.uuid4().hex}"), "w").close()
            return settle(rows)

        return run

    monkeypatch.setattr(mixing, "settler", spied)
    got = mixing.mix(docs).toPandas()
    assert max(int(f.split("-")[0]) for f in os.listdir(seen)) <= 3 * 32
    assert sorted(got["doc_id"]) == list(range(900))
    for _, rows in got.groupby("source"):
        assert abs(rows["taken"].sum() - rows["target"].iloc[0]) <= 2.5 + 1e-6


def test_many_rows_of_one_id(spark, monkeypatch):
    """A null id on most rows: groups stay bounded, targets are met, reruns agree."""
    from collections import Counter

    from pyspark.sql import functions as F

    from termweave.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", 64)
    docs = spark.range(2000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    parts = mixing.parts_of_copies(docs.select("doc_id", "source", F.lit(3).cast("long").alias("size")))
    per = parts.groupBy("doc_id", "source", "part").count().collect()
    assert max(r["count"] for r in per) <= 64 and sum(r["count"] for r in per) == 2000
    a, b = ([tuple(r) for r in mixing.mix(d).select("doc_id", "source", "taken").collect()] for d in (docs, docs.repartition(7)))
    assert Counter(a) == Counter(b) and len(a) == 2000
    assert abs(sum(t for _, _, t in a) - 9000) <= 6

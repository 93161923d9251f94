"""The pipeline's mixing stage when the scan is cut anew between its jobs."""

from collections import Counter

from termweave.llm import mixing, stages

SF = "/root/testdata/sf0.001"


def test_mix_sources_survives_another_cut_of_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{tmp_path}/docs"
    docs.repartition(3).write.parquet(path)
    out = stages.mix_sources(spark, spark.read.parquet(path), SF)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    size = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words = {r["doc_id"]: (r["source"], r["size"]) for r in mixing.mix(docs).collect()}
    taken, most = Counter(), Counter()
    for i, k in got.items():
        taken[words[i][0]] += k * words[i][1]
    for s, n in words.values():
        most[s] = max(most[s], n)
    for s, want in size.items():
        assert abs(taken[s] - want) <= most[s] / 2 + 1

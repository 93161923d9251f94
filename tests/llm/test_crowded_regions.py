"""Near copies in a region that is crowded at every depth and has no main component."""

import random

from termweave.llm import neardup


def test_near_duplicates_of_many_small_families_in_one_template(spark):
    """Families at 0.855 among hundreds of texts at 0.839, with little of their own to tell them apart."""
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(450):
        rows.append((i, " ".join(base + [f"f{i // 3}-{k}" for k in range(2)] + [f"d{i}-{k}" for k in range(17)])))
    random.Random(1).shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 3 for i in range(450)}


def test_a_star_and_a_clique_of_hot_keys(spark):
    """One node with most links, and null ends: components as by hand, no key's rows in one task alone."""
    from pyspark.sql import functions as F

    from termweave.llm.common import components, hot_join, save

    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(5000, 5050).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    none = spark.range(2).select(F.lit(None).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r["node"]: r["component"] for r in components(star.unionByName(chain).unionByName(none)).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5051)}
    left = save(spark.range(1000).select(F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 5 > 1, 7).otherwise(F.col("id"))).alias("k"), "id"), "left")
    right = spark.createDataFrame([(7, "x"), (1, "y")], "k long, v string")
    rows = hot_join(left, right, "k").collect()
    assert len(rows) == 1000 and all(r["v"] == {7: "x", 1: "y"}.get(r["k"]) for r in rows)

"""What an expression says is taken apart once, whatever is asked of its parts."""

from test_operators import one

from termweave.functions import expressions as E
from pyspark.sql import functions as F


def test_parts_are_computed_once(spark):
    plan = spark.range(1).select(E.sorted_conjuncts(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") <= 3  # has_top_or, the parts, and what is_bare asks of each


def test_odd_expressions(spark):
    lit = lambda t: F.lit(t).cast("string")
    want = {"A": "A", "": "", "A or B and C": "A or B and C", "A and (B or C)": "A and (B or C)", "A) and B": "A) and B", "H and p some X and 'Laterality' some Y and B": "H and B and p some X and 'Laterality' some Y", "H and 'some text' and (q some Z)": "H and 'some text' and (q some Z)"}
    for text, out in want.items():
        assert one(spark, E.sorted_conjuncts(lit(text))) == out
    assert one(spark, E.sorted_conjuncts(lit(None))) is None and one(spark, E.has_top_or(lit(None))) is None and one(spark, E.conjuncts(lit(None))) is None

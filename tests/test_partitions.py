"""Steps whose tasks grow in number with the table."""

import os

from termweave.sources import store


def test_triples_are_written_by_as_many_tasks_as_hold_them(spark, tmp_path):
    t = spark.range(0, 2000, 1, 20).selectExpr("'o' onto_id", "concat('s', id) s", "'p' p", "concat('o', id) o")
    store.write(t, str(tmp_path / "t"))
    assert len([f for f in os.listdir(tmp_path / "t" / "p=p") if f.endswith(".parquet")]) == 20
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2000

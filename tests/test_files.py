"""Texts that are written in many files are read as the documents they are."""

import pytest

from termweave import catalog

SQL = catalog.oracle_sql()


@pytest.fixture
def many_files(spark):
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["a03_segments", "s06_manchester", "k05_convert"])
def test_documents_of_many_files(name, same, many_files):
    same(catalog.queries()[name], SQL[name])

"""Every stage over odd tables: nulls, empty and repeated rows, empty tables, names that operators use inside."""

import pytest

import corpus_pipeline
from termweave.llm import stages

SF = "/root/testdata/sf0.001"
TEXT = "one two three four five six seven eight nine ten"
ROWS = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, "quite another text of its own with enough words to stay", "en", "a"), (2, TEXT, "en", "b"), (None, TEXT, None, None), (3, None, "en", "a"), (4, "", "en", None), (5, "mail a@b.co now", "fr", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, _key string, node string, row string, at int, label int, spans string, score double"
    return spark.createDataFrame([(*r, "k", "n", "r", 1, 2, "s", 0.5) for r in ROWS], schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_and_empty_tables(spark, odd, name, stage):
    for docs in (odd, odd.where("false")):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert name == "best_fit_packing" or out.columns == odd.columns
        assert docs is odd or not rows
    if name == "best_fit_packing":
        assert len(stage(spark, odd, SF).collect()) == len(ROWS)


def test_near_copies_go_by_row(spark, odd):
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in stages.drop_near_duplicates(spark, odd, SF).collect())
    assert got == sorted([(0, TEXT), (1, TEXT), (1, ROWS[2][1]), (3, ""), (4, ""), (5, ROWS[7][1])])


def test_a_copy_under_an_id_with_another_text(spark):
    """Row 2 of id 9 copies id 1 and goes; its other row stays."""
    docs = spark.createDataFrame([(1, TEXT), (9, TEXT), (9, ROWS[2][1])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, SF).collect()) == [1, 9]


def test_redaction(spark, odd):
    rows = {r["doc_id"]: r["text"] for r in stages.redact_personal_data(spark, odd, SF).collect() if r["doc_id"] in (3, 5)}
    assert rows == {3: None, 5: "mail [EMAIL] now"}

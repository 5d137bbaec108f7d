"""Every stage of the corpus pipeline on nulls, empty and very long texts, repeated rows,
an empty table and columns with names that the operators use themselves."""

import pytest

import corpus_pipeline
from tests.conftest import SF001

SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, LONG, "en", "b", len(LONG)),
        (5, SAME, "en", "b", 80), (5, SAME, "en", "b", 80), (6, SAME, None, "c", 80), (None, SAME, "en", None, 80),
        (None, None, "en", None, None), (7, "mail a.b@example.org now", "de", "c", 24)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS],
                                 "doc_id long, text string, lang string, source string, n_chars long, sig long, n long, p string")


def test_stages_keep_their_columns_and_say_what_becomes_of_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, odd, SF001)
    assert good.columns == odd.columns and good.count() == 0          # too few words, or one line over and over
    one = stages["near_duplicates"](spark, odd, SF001)
    assert one.columns == odd.columns
    assert sorted((r["doc_id"] for r in one.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 7], key=str)
    clean = stages["decontamination"](spark, odd, SF001)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    masked = stages["personal_data"](spark, odd, SF001)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect() if r["doc_id"]}
    assert "example.org" not in texts[7][0] and texts[7][1] == len(texts[7][0]) and texts[4][0] == LONG
    coded = {r["doc_id"]: r for r in stages["byte_bpe"](spark, odd, SF001).collect() if r["doc_id"]}
    assert coded[1]["n_tokens"] == coded[2]["n_tokens"] == 0 and coded[4]["round_trip"] and coded[4]["n_tokens"] > 10_000


def test_stages_of_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0

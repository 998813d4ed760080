"""The corpus pipeline on the small tables, and each stage on hostile rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from surgekit.llm.shared import DOCUMENT_COLUMNS, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "This sentence stands in a long and ordinary text about rivers, towns and the weather of the year number %d. "


@pytest.fixture(scope="module")
def hostile(spark):
    texts = [None, "", " \n ", "x", "!!! ### $$$", "word " * 3000, *["".join(LONG % (i * j) for j in range(9)) for i in range(8)] * 2]
    rows = [(i if i % 5 else None, t, None, "s", len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_hostile_and_empty_rows(spark, hostile, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (hostile, hostile.where("false")):
        out = stage(spark, docs, SF_SMALL)
        assert out.count() <= docs.count()
        if k < 4:
            assert out.columns == DOCUMENT_COLUMNS and dict(out.dtypes) == dict(docs.dtypes)


def test_run(spark):
    docs = table(spark, SF_SMALL, "documents")
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    n = out.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    assert 0.3 * docs.count() < n[0] == n[1] <= docs.count()

"""Settings of a session and what they decide."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import classify, ocr, retrieve
from foliospark.plans import batch
from foliospark.settings import PREFIX, Settings, settings


@pytest.fixture
def conf(spark):
    """Sets settings of the session for one test."""
    given = []

    def put(**values):
        for name, value in values.items():
            spark.conf.set(PREFIX + name, str(value))
            given.append(name)

    yield put
    for name in given:
        spark.conf.unset(PREFIX + name)


def test_defaults_and_overrides(spark, conf):
    assert settings(spark) == Settings()
    conf(chunk_size=800, low_confidence=0.5)
    assert settings(spark) == Settings(chunk_size=800, low_confidence=0.5)


@pytest.mark.parametrize("wrong", [{"chunk_length": 3}, {"nearest": "three"}, {"nearest": 0}, {"chunk_overlap": 400}, {"ocr_regions": -1}])
def test_wrong_settings(spark, conf, wrong):
    conf(**wrong)
    with pytest.raises(ValueError):
        settings(spark)


def test_chunks_and_neighbours(spark, conf):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string")
    pieces = lambda **given: [r["chunk"] for r in retrieve.chunks_fixed(docs, **given).orderBy("chunk_id").collect()]
    assert pieces() == ["abcdefghij"]
    conf(chunk_size=4, chunk_overlap=1, nearest=2)
    assert pieces() == ["abcd", "defg", "ghij"]
    assert pieces(size=8, overlap=2) == ["abcdefgh", "ghij"]
    assert [r["chunk"] for r in retrieve.chunks_recursive(docs).orderBy("chunk_id").collect()][0] == "abcd"
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r["vec_id"] for r in retrieve.top_k(asked, vectors).orderBy("rank").collect()] == [0, 1]
    assert retrieve.top_k(asked, vectors, 3).count() == 3


def test_decisions(spark, conf):
    passes = spark.createDataFrame([(1, 1, 1, False, 0.8, 9, "first"), (1, 1, 2, False, 0.9, 9, "second")], "doc_id long, page int, pass int, cleaned boolean, conf double, n_regions int, text string")
    assert ocr.waterfall(passes).first()["text"] == "second"
    docs = spark.createDataFrame([(1, "Invoice Number : AB12345")], "inv_id long, text string")
    before = batch.process(docs, "2030-01-01").first()
    assert before["fields_extracted"] < 5 and before["status"] == "partial"
    conf(ocr_sure=0.8, fields_for_success=1, fields_for_partial=1)
    assert ocr.waterfall(passes).first()["text"] == "first"
    after = batch.process(docs, "2030-01-01").first()
    assert after["status"] == ("success" if after["passed"] else "partial")
    few = spark.range(1).select(classify.needs_fallback(F.lit(3)).alias("a"), classify.needs_fallback(F.lit(3), Settings(fields_for_no_fallback=3)).alias("b")).first()
    assert few["a"] and not few["b"]

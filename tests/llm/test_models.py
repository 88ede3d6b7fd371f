"""Quality and language: held-out accuracy, calibration, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import language_filters, quality_model
from riffle.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    found = QUERIES["op1_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    test = found[found.held_out].merge(labels, on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.97
    assert ((found.score >= 0) & (found.score <= 1)).all() and len(found) == 1000
    assert abs(test.score.mean() - test.quality.mean()) < 0.05  # calibrated in the mean


def test_quality_of_odd_rows(odd, none):
    labels = odd.select("doc_id", F.when(F.col("doc_id") > 5, 1).when(F.col("doc_id") > 1, 0).alias("quality"))
    model = quality_model.fit(odd, labels)
    scored = quality_model.score(odd, model)
    assert scored.columns == [*odd.columns, "quality_score"]
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 5 and r.text == rows[0].text}) == 1
    assert len({r.quality_score for r in rows if not (r.text or "").strip()}) == 1
    assert quality_model.score(none, model).collect() == []
    empty = quality_model.score(odd, quality_model.fit(none, labels.where("false"))).select("quality_score").distinct().collect()
    assert [r[0] for r in empty] == [0.5]


def test_index_vectors_are_fixed_and_sparse():
    places, signs = quality_model.index_vectors(np.arange(1000, dtype=np.uint64))
    again = quality_model.index_vectors(np.arange(1000, dtype=np.uint64))
    assert (places == again[0]).all() and set(np.unique(signs)) == {-1.0, 1.0} and abs(signs.mean()) < 0.1


def test_language_held_out(spark):
    found = QUERIES["op2_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(found, on="doc_id")
    assert (docs[docs.held_out].lang == docs[docs.held_out].lang_pred).mean() > 0.99
    assert ((docs.score >= 0) & (docs.score <= 1)).all()


def test_filters_return_all_languages_of_an_ngram():
    held = {"a": np.array([10, 11, 12], np.uint32), "b": np.array([12, 13], np.uint32), "c": np.array([], np.uint32)}
    filters = language_filters.LanguageFilters.build(held, ["a", "b", "c"])
    assert filters.masks(np.array([10, 12, 13, 99], np.uint32))[:, 0].tolist() == [1, 3, 2, 0]
    many = [f"l{i}" for i in range(70)]
    wide = language_filters.LanguageFilters.build({x: np.array([i], np.uint32) for i, x in enumerate(many)}, many)
    assert wide.rows.shape[1] == 2 and wide.masks(np.array([66], np.uint32))[0].tolist() == [0, 4]


@pytest.mark.parametrize("learned", [True, False])
def test_language_of_odd_rows(spark, odd, none, learned):
    train = spark.createDataFrame([("the cat and the dog sat there", "en")] * 5 + [("der hund und die katze", "de")] * 5 + [(None, "fr"), ("x", None)], "text string, lang string")
    filters = language_filters.fit(train if learned else train.where("false"))
    found = language_filters.predict(odd, filters)
    assert found.columns == [*odd.columns, "lang_pred", "score"]
    for r in found.collect():
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters or not learned)
        assert 0 <= r.score <= 1
    assert language_filters.predict(none, filters).collect() == []

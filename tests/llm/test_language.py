import tracemalloc

import numpy as np
import pandas as pd
import pytest

from postlytics.llm import language

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    return language.fit_languages(docs.filter(~language.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").filter(language.held_out())
    found = language.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count() > 30
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 and 0 <= r.known <= 1 for r in found)


def test_odd_documents(spark, model, documents, nothing):
    found = language.predict_languages(documents, model).collect()
    assert len(found) == documents.count()
    assert {(r.doc_id, r.lang_pred, r.score) for r in found if r.doc_id in (9, 10, 11)} == {(i, "und", 0.0) for i in (9, 10, 11)}
    assert (1 << 53) + 1 in {r.doc_id for r in found}
    assert language.predict_languages(nothing, model).count() == 0
    kept = language.keep_identified(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()}.isdisjoint({9, 10, 11})


def test_learnt_from_nothing(spark, nothing, documents):
    empty = language.fit_languages(nothing)
    assert {r.lang_pred for r in language.predict_languages(documents, empty).collect()} == {"und"}


def test_grams_of_pieces():
    two, three, four = language.gram_hashes("Ab, c")
    assert [len(x) for x in (two, three, four)] == [5, 3, 1]
    assert all(len(x) == 0 for x in language.gram_hashes("12 !") + language.gram_hashes(None))


def test_long_text_is_read_whole(model):
    text = "ß " * 600_000 + "the of and that with " * 200_000
    assert model.predict(text)[0] == model.predict("the of and that with " * 200_000)[0]


def test_a_batch_is_counted_in_bounded_memory():
    texts = pd.Series(["the river ran past the old mill " * 40, "", "und das war es", None] * 8_000)
    tracemalloc.start()
    counted = list(language.gram_counts(texts[texts.notna()]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = {n: sum(len(language.gram_hashes(t)[i]) for t in texts[:2].tolist() + ["und das war es"]) for i, n in enumerate(language.GRAMS)}
    assert {n: int(times.sum()) for n, _, times in counted} == {n: x * 8_000 for n, x in whole.items()}
    assert all(np.all(gram[1:] > gram[:-1]) for _, gram, _ in counted)
    # All hashes of all lengths at once would be over 200 MB.
    assert most < 150e6

"""Every query of the training-data operators on the smallest tables, and its SQL twin if it has one."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import differences, duck
from postlytics.llm.oracles import ORACLES
from postlytics.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

# What each query returns at least, and the table whose rows it has one by one.
COLUMNS = {
    "op1_html": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op2_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op3_licenses": (None, "doc_id bigint, family string"),
    "op4_substrings": ("documents", "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"),
    "op5_embeddings": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op6_language": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op7_pii": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op8_decontaminate": (None, "doc_id bigint, item_id bigint"),
    "op9_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op10_secrets": ("documents", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
    "op11_phrases": (None, "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"),
    "op12_negatives": (None, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"),
    "op13_topk": (None, "query_id bigint, rank int, vec_id bigint, score bigint"),
}


def test_all_are_registered():
    assert QUERIES.keys() == COLUMNS.keys()
    assert queries().keys() >= {*QUERIES, "pipeline"} and oracle_sql().keys() >= ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    table, columns = COLUMNS[name]
    found = queries()[name](spark, FOLDER)
    assert {tuple(c.split()) for c in columns.split(", ")} <= set(found.dtypes)
    rows = found.toPandas()
    assert len(rows)
    if table:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in ORACLES:
        assert differences(rows, duck(FOLDER).execute(ORACLES[name]).df()) == ""

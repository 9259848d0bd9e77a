"""Each operator of the training-data pipeline over its whole test table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm import decontaminate, embeddings, html, language, licenses, mixing, negatives, phrases, pii, secrets, simhash, substrings, topk
from postlytics.llm.words import count_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.find_licences(docs, licenses.fit_licences(docs))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.filter(~language.held_out()))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "known")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit_field(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, size="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit_guess_cost(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return topk.nearest(table.filter(F.col("vec_id") % 20 == 0), table)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_substrings": op4_substrings,
    "op5_embeddings": op5_embeddings,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "op11_phrases": op11_phrases,
    "op12_negatives": op12_negatives,
    "op13_topk": op13_topk,
}

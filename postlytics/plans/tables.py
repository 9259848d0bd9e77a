"""Post tables in the shape the operators take, from the star-schema test tables.

A post is one line of a document (blank lines count), its author the document.
The data has no part-of-speech tags, so a fixed rule over the spelling stands in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.text import split_words

TAG_RULE = """CASE WHEN substr(w,1,1) BETWEEN 'A' AND 'Z' THEN '^'
     WHEN right(w,1) IN ('.',',') THEN ','
     WHEN length(w) >= 7 THEN 'N'
     ELSE 'V' END"""

# What stands behind an object and breaks its line.
JUNK = ("] xyz", "]", "][", " {}", '],[{"id":2}', " }", "] }")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, spread over the cores where its file gives too few tasks.

    Each test file is one row group and so one task; a table of many files has
    tasks enough and is read as it lies.
    """
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as posts, for plain word counts."""
    return table(spark, sf_dir, "documents").select(split_words(F.col("text")).alias("tokens"))


def line_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as tagged posts of the document's author."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"),
        F.col("source").alias("user_name"),
        F.col("lang").alias("user_description"),
        F.explode(F.split("text", "\n")).alias("line"),
    )
    tokens = lines.withColumn("tokens", split_words(F.col("line"))).drop("line")
    return tokens.withColumn("tags", F.expr(f"transform(tokens, w -> {TAG_RULE})"))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: only ids."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), "user_id")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw JSON lines; every 97th line is cut short or has ``JUNK`` behind it."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.struct(F.col("user_id").alias("id")).alias("user"),
            F.col("event_type").alias("text"),
        )
    )
    kinds = [F.substring(line, F.lit(1), F.length(line) - 1), *(F.concat(line, F.lit(junk)) for junk in JUNK)]
    broken = F.get(F.array(*kinds), F.pmod(F.floor(F.col("event_id") / 97), F.lit(len(kinds))).cast("int"))
    return events.select(F.when(F.col("event_id") % 97 == 0, broken).otherwise(line).alias("value"))

"""Corpus counts and histograms of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.functions.text import each


def unique_posts(posts: DataFrame) -> DataFrame:
    """Number of distinct post ids; lines without an id do not count."""
    return posts.agg(F.count_distinct("post_id").alias("unique_posts"))


def malformed_posts(posts: DataFrame) -> DataFrame:
    """Number of lines that name no author."""
    return posts.agg(F.count_if(F.col("user_id").isNull()).alias("malformed_posts"))


def words(posts: DataFrame) -> DataFrame:
    """One row ``word`` per token occurrence in ``posts.tokens``."""
    return posts.select(each(F.col("tokens")).alias("word"))


def vocabulary_size(posts: DataFrame) -> DataFrame:
    """Number of distinct words, case kept."""
    return words(posts).agg(F.count_distinct("word").alias("vocabulary_size"))


def count_per_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per value of ``key``; rows without one are dropped."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def posts_per_user(posts: DataFrame) -> DataFrame:
    return count_per_key(posts, "user_id", "n_posts")


def count_histogram(
    df: DataFrame, key: str, ascending: bool = True, limit: int | None = None
) -> DataFrame:
    """How many keys occur how often: ``(n, keys)`` in the order of ``n``.

    Both counts combine before their shuffle, so a key with most of the rows
    and a count shared by most of the keys each send one row per task.
    """
    histogram = count_per_key(df, key).groupBy("n").agg(F.count("*").alias("keys"))
    ordered = histogram.orderBy("n", ascending=ascending)
    return ordered if limit is None else ordered.limit(limit)


def user_post_histogram(posts: DataFrame) -> DataFrame:
    """Users by number of posts, most posts first."""
    return count_histogram(posts, "user_id", ascending=False)


def word_frequency_histogram(posts: DataFrame, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """Words by number of occurrences."""
    return count_histogram(words(posts), "word", ascending, limit)

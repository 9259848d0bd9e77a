"""Whole jobs from post files to results, one function per job.

Every job takes a session and a list of paths (``numbered_paths`` makes one for
a numbered corpus) and gives a DataFrame; nothing runs until it is read, but for
the staged tables a job needs on its way.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.text import split_words
from postlytics.operators import clustering, counts, informativeness, profiles, reports
from postlytics.sources.posts import read_raw_posts, read_tagged_posts
from postlytics.sources.staging import cut_lineage, free


def count_unique_posts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return counts.unique_posts(read_raw_posts(spark, paths, ["post_id"]))


def count_malformed_posts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return counts.malformed_posts(read_raw_posts(spark, paths, ["user_id"]))


def user_post_histogram(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``(n, keys)``: number of users per number of posts, most posts first."""
    return counts.user_post_histogram(read_raw_posts(spark, paths, ["user_id"]))


def _raw_words(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return read_raw_posts(spark, paths, ["text"]).select(split_words(F.col("text")).alias("tokens"))


def count_unique_words(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return counts.vocabulary_size(_raw_words(spark, paths))


def word_frequency_histogram(
    spark: SparkSession, paths: Iterable[str], ascending: bool = True, limit: int | None = None
) -> DataFrame:
    """``(n, keys)``: number of words per number of occurrences; its rows are all that there are unless ``limit`` is given."""
    return counts.word_frequency_histogram(_raw_words(spark, paths), ascending, limit)


def informative_words(
    spark: SparkSession, paths: Iterable[str], pair_count_above: int | None = None
) -> DataFrame:
    """``(token, tag, jsd)``, least informative words first."""
    posts = read_tagged_posts(spark, paths, [])
    return informativeness.informative_words(posts, pair_count_above=pair_count_above).orderBy(
        "jsd", "token", "tag"
    )


def cluster_users(
    spark: SparkSession,
    paths: Iterable[str],
    k: int = clustering.CLUSTERS,
    tol: float = clustering.TOLERANCE,
    max_iter: int = clustering.MAX_ROUNDS,
    min_posts: int = profiles.MIN_POSTS,
    min_occurs: int = profiles.MIN_OCCURS,
    seed: str = "",
) -> clustering.KMeansFit:
    """Cluster the active users; keep the result with ``write_centers`` and ``write_vocabulary`` of ``sources.centers``."""
    posts = read_tagged_posts(spark, paths, ["user_id"])
    found = profiles.build_profiles(posts, min_posts, min_occurs)
    fitted = clustering.fit(profiles.user_vectors(found), k, tol, max_iter, seed=seed)
    # Centres and words are staged by themselves; what they were made from is not read again.
    for staged in (found.terms, found.users):
        free(staged)
    return fitted._replace(vocabulary=found.vocabulary)


def _predictions(found: profiles.Profiles, centers: DataFrame) -> DataFrame:
    """Assigned users, staged because the reports read them more than once."""
    predictions = clustering.assign(profiles.user_vectors(found), centers)
    return cut_lineage(predictions.select("user_id", "n_posts", "cid", "distance2"), "predictions")


def predict_users(
    spark: SparkSession,
    paths: Iterable[str],
    centers: DataFrame,
    min_posts: int = profiles.MIN_POSTS,
    min_occurs: int = profiles.MIN_OCCURS,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``(cid, user_id)``: the members of each saved centre.

    ``vocabulary`` is the one that the centres were made with. Without it one is built
    from these paths, which only means the same words if paths and limits are the same.
    """
    posts = read_tagged_posts(spark, paths, ["user_id"])
    found = profiles.build_profiles(posts, min_posts, min_occurs, vocabulary)
    return reports.cluster_members(_predictions(found, centers), centers)


def analyze_clusters(
    spark: SparkSession,
    paths: Iterable[str],
    centers: DataFrame,
    min_posts: int = profiles.MIN_POSTS,
    min_occurs: int = profiles.MIN_OCCURS,
    n: int = 100,
    vocabulary: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Top tokens and top users of each saved centre; ``vocabulary`` as in ``predict_users``.

    Words and names are read from the files, each pass parsing only what it needs: parsed
    posts beside the counts that are made from them would be the most that lies on disk.
    """
    posts = read_tagged_posts(spark, paths).drop("tags")
    found = profiles.build_profiles(posts, min_posts, min_occurs, vocabulary)
    predictions = _predictions(found, centers)
    free(found.terms)
    return (
        reports.cluster_top_tokens(centers, found.vocabulary, n),
        reports.cluster_top_users(predictions, posts, n),
    )

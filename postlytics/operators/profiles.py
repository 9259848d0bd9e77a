"""Author profiles: active authors, their frequent words and term weights."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlytics.functions.membership import bloom_filter, may_hold
from postlytics.sources.staging import cut_lineage

# Posts of an active author, occurrences of a frequent word.
MIN_POSTS = 7
MIN_OCCURS = 10_000
# Largest vocabulary that is broadcast: a short string and an int per word.
BROADCAST_TERMS = 1_000_000


class Profiles(NamedTuple):
    """Active authors with the counts of all their words, and the vocabulary.

    users       (user_id, n_posts)
    terms       (user_id, n_posts, token, occurs)
    vocabulary  (token, occurs, idx), idx dense from 0 in the order of the tokens
    size        number of words in the vocabulary
    """

    users: DataFrame
    terms: DataFrame
    vocabulary: DataFrame
    size: int


def user_token_counts(posts: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, n_posts, token, occurs)`` of the authors in ``users``.

    A Bloom filter of the authors drops nearly all other posts before their words
    are spread out. Words are then counted per author and only the counts meet
    the authors: however many posts an author wrote, one row for each of the
    author's distinct words does, and their shuffle is by author and word.
    """
    theirs = may_hold(posts.select("user_id", "tokens"), "user_id", bloom_filter(users, "user_id"))
    words = theirs.select("user_id", F.explode("tokens").alias("token"))
    counted = words.groupBy("user_id", "token").agg(F.count("*").alias("occurs"))
    return counted.join(users, "user_id").select("user_id", "n_posts", "token", "occurs")


def active_users(posts: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    """``(user_id, n_posts)`` of authors with at least ``min_posts`` posts."""
    per_user = posts.filter(F.col("user_id").isNotNull()).groupBy("user_id")
    return per_user.agg(F.count("*").alias("n_posts")).filter(F.col("n_posts") >= min_posts)


def dense_index(words: DataFrame) -> DataFrame:
    """Adds ``idx``, the position of ``token`` in sorted order from 0.

    The words are sorted by range into parts; a part's first index is the number
    of words in the parts before it.  Only the part sizes meet in one task.
    """
    ranged = words.repartitionByRange("token").withColumn("part", F.spark_partition_id())
    staged = cut_lineage(ranged, "vocabulary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy("part").agg(F.count("*").alias("size"))
    offsets = offsets.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("token")) - 1
    indexed = staged.join(F.broadcast(offsets), "part").withColumn("idx", (F.col("offset") + within).cast("int"))
    return indexed.drop("part", "offset")


def build_profiles(
    posts: DataFrame,
    min_posts: int = MIN_POSTS,
    min_occurs: int = MIN_OCCURS,
    vocabulary: DataFrame | None = None,
) -> Profiles:
    """Profiles of the authors with ``min_posts`` posts, over the words that occur
    ``min_occurs`` times in their posts together, or over a ``vocabulary`` (token, idx) made before."""
    users = cut_lineage(active_users(posts, min_posts), "users")
    terms = cut_lineage(user_token_counts(posts, users), "terms")
    if vocabulary is None:
        frequent = terms.groupBy("token").agg(F.sum("occurs").alias("occurs")).filter(F.col("occurs") >= min_occurs)
        vocabulary = cut_lineage(dense_index(frequent), "vocabulary")
    return Profiles(users, terms, vocabulary, vocabulary.count())


def user_term_weights(profiles: Profiles) -> DataFrame:
    """``(user_id, idx, weight)``: occurrences of a vocabulary word per post of the author."""
    lookup = profiles.vocabulary.select("token", "idx")
    if profiles.size <= BROADCAST_TERMS:
        lookup = F.broadcast(lookup)
    weight = F.col("occurs") / F.col("n_posts")
    return profiles.terms.join(lookup, "token").select("user_id", "idx", weight.alias("weight"))


def user_vectors(profiles: Profiles) -> DataFrame:
    """``(user_id, n_posts, indices, values)``: one sparse vector per active author.

    An author without a vocabulary word has the zero vector.  A vector holds at
    most one entry per word of the vocabulary.
    """
    weights = user_term_weights(profiles).select("user_id", F.struct("idx", "weight").alias("entry"), F.lit(None).cast("bigint").alias("n_posts"))
    every = profiles.users.select("user_id", F.lit(None).cast("struct<idx: int, weight: double>").alias("entry"), "n_posts")
    vectors = weights.unionByName(every).groupBy("user_id").agg(
        F.max("n_posts").alias("n_posts"), F.sort_array(F.collect_list("entry")).alias("entries")
    )
    return vectors.select(
        "user_id",
        "n_posts",
        F.col("entries.idx").alias("indices"),
        F.col("entries.weight").alias("values"),
    )

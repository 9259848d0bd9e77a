"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.operators import clustering, counts, informativeness, profiles, reports
from postlytics.plans import tables
from postlytics.sources.centers import read_centers, write_centers
from postlytics.sources.posts import parse_raw_posts, read_raw_posts, read_tagged_posts, union_posts
from postlytics.sources.staging import cut_lineage, scratch_path

MIN_POSTS = 7
MIN_OCCURS = 100
K = 10
ROUNDS = 3
TOP = 100
# A coordinate no author is near.
FAR = 1e4
# Summed squared move of all centres.
TOLERANCE = 0.75
MOST_ROUNDS = 7
# Pairs counted more often than this pass the long-tail filter.
LONG_TAIL = 2


def unique_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.event_posts(spark, sf_dir)
    return counts.unique_posts(union_posts([posts, posts]))


def malformed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.malformed_posts(parse_raw_posts(tables.event_lines(spark, sf_dir), ["user_id"]))


def raw_post_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written to two folders and read back as one scan."""
    lines = tables.event_lines(spark, sf_dir)
    paths = [scratch_path(spark, "raw-posts") for _ in range(2)]
    for at, path in enumerate(paths):
        lines.filter(F.pmod(F.hash("value"), F.lit(2)) == at).write.text(path)
    return read_raw_posts(spark, paths)


def tagged_post_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged lines written as text and read back, as words and tags per author."""
    user = F.struct(F.col("user_id").alias("id"), F.col("user_name").alias("name"))
    junk = F.array(*[F.lit(x) for x in tables.JUNK])
    at = F.pmod(F.floor(F.col("user_id") / 7), F.lit(len(tables.JUNK))).cast("int")
    line = F.concat_ws(
        "\t",
        F.array_join("tokens", " "),
        F.array_join("tags", " "),
        F.lit("-"),
        # Every seventh author's object has junk behind it.
        F.concat(F.to_json(F.struct(user.alias("user"))), F.when(F.col("user_id") % 7 == 3, F.get(junk, at)).otherwise("")),
    )
    path = scratch_path(spark, "tagged-posts")
    tables.line_posts(spark, sf_dir).select(line.alias("value")).write.text(path)
    posts = read_tagged_posts(spark, [path], ["user_id", "user_name"])
    content = F.size(F.filter("tags", lambda tag: tag == "N"))
    return posts.groupBy("user_id").agg(
        F.count("*").alias("n_posts"),
        F.min("user_name").alias("user_name"),
        F.sum(F.size("tokens")).alias("tokens"),
        F.sum(content).alias("nouns"),
    )


def posts_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.posts_per_user(tables.event_posts(spark, sf_dir))


def user_post_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.user_post_histogram(tables.event_posts(spark, sf_dir))


def union_distinct_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), "event_type")
    views = events.filter(F.col("event_type") == "view")
    others = events.filter(F.col("event_type") != "view")
    return union_posts([views, others, views]).select("post_id").distinct()


def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.vocabulary_size(tables.document_posts(spark, sf_dir))


def word_frequency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.word_frequency_histogram(tables.document_posts(spark, sf_dir))


def word_frequency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.word_frequency_histogram(tables.document_posts(spark, sf_dir), ascending=False, limit=TOP)


def word_frequency_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.word_frequency_histogram(tables.document_posts(spark, sf_dir), ascending=True, limit=TOP)


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return informativeness.document_frequency(tables.line_posts(spark, sf_dir))


def word_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, reported per first word and tag of the second.

    Every pair is counted and named; the sums keep the report to a size that a
    caller can collect, where the listing has millions of rows on small tables.
    """
    sums = {
        "partners": informativeness.Sum(F.count("*")),
        "pair_sum": informativeness.Sum(F.sum("pair_count")),
        "top_count": informativeness.Sum(F.max("pair_count"), F.max),
        "letters": informativeness.Sum(F.sum(F.length("token2") * F.col("pair_count"))),
    }
    posts = tables.line_posts(spark, sf_dir)
    return informativeness.word_pair_counts(posts, by=["token1", "tag1", "tag2"], sums=sums)


def word_pair_counts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.line_posts(spark, sf_dir)
    return informativeness.word_pair_counts(posts, pair_count_above=LONG_TAIL)


def word_pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return informativeness.word_pair_sums(tables.line_posts(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def informative_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(informativeness.informative_words(tables.line_posts(spark, sf_dir)), "jsd")


def informative_words_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.line_posts(spark, sf_dir)
    return _rounded(informativeness.informative_words(posts, pair_count_above=LONG_TAIL), "jsd")


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.active_users(tables.line_posts(spark, sf_dir), MIN_POSTS)


def _profiles(spark: SparkSession, sf_dir: str) -> profiles.Profiles:
    return profiles.build_profiles(tables.line_posts(spark, sf_dir), MIN_POSTS, MIN_OCCURS)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).vocabulary


def user_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.user_term_weights(_profiles(spark, sf_dir)), "weight")


def _vectors(found: profiles.Profiles) -> DataFrame:
    return cut_lineage(profiles.user_vectors(found), "vectors")


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(_profiles(spark, sf_dir))
    predictions = clustering.assign(vectors, clustering.sample_centers(vectors, K))
    return _rounded(predictions.select("user_id", "cid", "distance2"), "distance2")


def kmeans_assign_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment, joined back to the authors it is of."""
    found = _profiles(spark, sf_dir)
    vectors = _vectors(found)
    predictions = clustering.assign(vectors, clustering.sample_centers(vectors, K))
    return _rounded(found.users.join(predictions, "user_id").select("user_id", "cid", "distance2"), "distance2")


def _one_round(vectors: DataFrame) -> DataFrame:
    return cut_lineage(clustering.lloyd_step(vectors, clustering.sample_centers(vectors, K)), "centers")


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = _one_round(_vectors(_profiles(spark, sf_dir)))
    return _rounded(clustering.center_entries(centers), "value")


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = profiles.user_vectors(_profiles(spark, sf_dir))
    found = clustering.fit(vectors, k=K, tol=0.0, max_iter=ROUNDS)
    return _rounded(clustering.center_entries(found.centers), "value")


def kmeans_empty_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round from centres of which one, far off, gets no author and stays."""
    vectors = _vectors(_profiles(spark, sf_dir))
    far = spark.createDataFrame([(K, [0], [FAR])], "cid int, indices array<int>, values array<double>")
    centers = clustering.sample_centers(vectors, K).unionByName(far)
    return _rounded(clustering.center_entries(clustering.fit(vectors, tol=0.0, max_iter=1, centers=centers).centers), "value")


def kmeans_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until the centres move by no more than ``TOLERANCE``; on the usual tables that is before the last."""
    vectors = profiles.user_vectors(_profiles(spark, sf_dir))
    found = clustering.fit(vectors, k=K, tol=TOLERANCE, max_iter=MOST_ROUNDS)
    centers = clustering.center_entries(found.centers).withColumn("rounds", F.lit(found.iterations).cast("bigint"))
    return _rounded(centers, "value")


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[profiles.Profiles, DataFrame, DataFrame]:
    found = _profiles(spark, sf_dir)
    vectors = _vectors(found)
    centers = _one_round(vectors)
    return found, centers, cut_lineage(clustering.assign(vectors, centers).drop("indices", "values"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centers, predictions = _clusters(spark, sf_dir)
    return reports.cluster_members(predictions, centers)


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centers, predictions = _clusters(spark, sf_dir)
    return reports.cluster_sizes(predictions, centers)


def cluster_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profiles(spark, sf_dir)
    centers = _one_round(_vectors(found))
    return _rounded(reports.cluster_top_tokens(centers, found.vocabulary, TOP), "weight")


def cluster_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, predictions = _clusters(spark, sf_dir)
    return reports.cluster_top_users(predictions, tables.line_posts(spark, sf_dir), TOP)


def centers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after one round, written in each form and read back."""
    centers = _one_round(_vectors(_profiles(spark, sf_dir)))
    read = []
    for form in ("table", "blocks", "lines"):
        path = scratch_path(spark, f"centers-{form}")
        write_centers(centers, path, form)
        back = clustering.center_entries(read_centers(spark, path, form, k=K))
        read.append(back.select(F.lit(form).alias("form"), "cid", "idx", "value"))
    return _rounded(union_posts(read), "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        unique_posts,
        malformed_posts,
        raw_post_scan,
        tagged_post_scan,
        posts_per_user,
        user_post_histogram,
        union_distinct_posts,
        vocabulary_size,
        word_frequency_histogram,
        word_frequency_top,
        word_frequency_bottom,
        document_frequency,
        word_pair_counts,
        word_pair_counts_filtered,
        word_pair_sums,
        informative_words,
        informative_words_filtered,
        active_users,
        vocabulary,
        user_term_weights,
        kmeans_assign,
        kmeans_assign_by_join,
        kmeans_step,
        kmeans_fit,
        kmeans_empty_cluster,
        kmeans_stop,
        cluster_members,
        cluster_sizes,
        cluster_top_tokens,
        cluster_top_users,
        centers_round_trip,
    )
}

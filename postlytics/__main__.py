"""Run one job over post files and write its report.

    python -m postlytics informative-words --output out posts/t01 posts/t02
    python -m postlytics cluster-users --output centers --numbered posts/t 1 70 --numbered posts/u 1 85
    python -m postlytics analyze-clusters --output report --centers centers --numbered posts/t 1 70
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from postlytics.operators import clustering, profiles
from postlytics.plans import jobs
from postlytics.sources.centers import read_centers, read_vocabulary, write_centers, write_vocabulary
from postlytics.sources.observed import ROWS, observe
from postlytics.sources.posts import numbered_paths
from postlytics.sources.reports import write_report

COUNTS = {
    "unique-posts": jobs.count_unique_posts,
    "malformed-posts": jobs.count_malformed_posts,
    "unique-words": jobs.count_unique_words,
    "user-histogram": jobs.user_post_histogram,
    "word-histogram": jobs.word_frequency_histogram,
    "informative-words": jobs.informative_words,
}
# What is told of a result besides, counted while it is written.
COUNTED = {
    "user-histogram": {**ROWS, "users": "sum(keys)"},
    "word-histogram": {**ROWS, "words": "sum(keys)"},
    "predict-users": {**ROWS, "users": "count(user_id)"},
}
CLUSTERS = ("cluster-users", "predict-users", "analyze-clusters")


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(
        prog="postlytics", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    parser.add_argument("job", choices=[*COUNTS, *CLUSTERS])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--numbered", nargs=3, action="append", default=[], metavar=("PREFIX", "FIRST", "LAST"))
    parser.add_argument("--output", required=True)
    parser.add_argument("--centers", help="saved centres, for predict-users and analyze-clusters")
    parser.add_argument("--form", default="table", choices=["table", "blocks", "lines"], help="form of the centres")
    parser.add_argument("--k", type=int, default=clustering.CLUSTERS)
    parser.add_argument("--tol", type=float, default=clustering.TOLERANCE)
    parser.add_argument("--max-iter", type=int, default=clustering.MAX_ROUNDS)
    parser.add_argument("--limit", type=int, help="rows of word-histogram; all if not given")
    parser.add_argument("--descending", action="store_true", help="word-histogram from the most occurrences down")
    parser.add_argument("--pair-count-above", type=int, help="informative-words: pairs counted more often than that")
    parser.add_argument("--min-posts", type=int, default=profiles.MIN_POSTS)
    parser.add_argument("--min-occurs", type=int, default=profiles.MIN_OCCURS)
    return parser.parse_intermixed_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    paths = list(args.paths)
    for prefix, first, last in args.numbered:
        folder, name = os.path.split(prefix)
        paths += numbered_paths(folder, name, int(first), int(last))
    spark = SparkSession.builder.appName(f"postlytics-{args.job}").getOrCreate()
    limits = {"min_posts": args.min_posts, "min_occurs": args.min_occurs}

    if args.job == "word-histogram":
        found = jobs.word_frequency_histogram(spark, paths, not args.descending, args.limit)
        told = write_report(found, args.output, COUNTED[args.job])
    elif args.job == "informative-words":
        told = write_report(jobs.informative_words(spark, paths, args.pair_count_above), args.output)
    elif args.job in COUNTS:
        told = write_report(COUNTS[args.job](spark, paths), args.output, COUNTED.get(args.job, ROWS))
    elif args.job == "cluster-users":
        fitted = jobs.cluster_users(spark, paths, args.k, args.tol, args.max_iter, **limits)
        centers, counted = observe(fitted.centers)
        write_centers(centers, args.output, args.form)
        write_vocabulary(fitted.vocabulary, args.output)
        told = counted() | {"users": fitted.users}
    else:
        centers = read_centers(spark, args.centers, args.form)
        limits["vocabulary"] = read_vocabulary(spark, args.centers)
        if args.job == "predict-users":
            members = jobs.predict_users(spark, paths, centers, **limits)
            told = write_report(members.orderBy("cid", "user_id"), args.output, COUNTED[args.job])
        else:
            tokens, users = jobs.analyze_clusters(spark, paths, centers, **limits)
            told = write_report(tokens.orderBy("cid", "rank"), f"{args.output}/tokens", {"tokens": "count(1)"})
            told |= write_report(users.orderBy("cid", "rank"), f"{args.output}/users", {"users": "count(1)"})
    print(", ".join(f"{n} {name}" for name, n in told.items()))


if __name__ == "__main__":
    main()

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlytics.__main__ import main
from postlytics.plans import job_queries, jobs
from postlytics.sources.centers import read_centers, read_vocabulary, write_centers, write_vocabulary
from postlytics.sources.posts import read_lines
from postlytics.sources.staging import cut_lineage, shared_folder


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Raw and tagged files of one small corpus, with broken lines in both."""
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(3)
    posts = []
    for post_id in range(400):
        user = rng.randrange(20)
        topic = "ab"[user % 2]
        words = [f"{topic}{rng.randrange(6)}" for _ in range(rng.randint(1, 6))]
        posts.append((post_id // 2 * 2, user, words))
    paths = {"raw": [], "tagged": []}
    for kind in paths:
        for part in range(2):
            path = folder / f"{kind}{part}"
            paths[kind].append(str(path))
            with open(path, "w") as out:
                for post_id, user, words in posts[part::2]:
                    body = json.dumps(
                        {"id": post_id, "user": {"id": user, "name": f"n{user}", "description": "d"}, "text": " ".join(words)}
                    )
                    tags = " ".join("N" if w[0] == "a" else "V" for w in words)
                    out.write(body if kind == "raw" else f"{' '.join(words)}\t{tags}\t0\t{body}")
                    out.write("\n")
                out.write('{"id": 1, "user"\nx\n')
    return posts, paths


def test_corpus_counts(spark, corpus):
    posts, paths = corpus
    raw = paths["raw"]
    assert jobs.count_unique_posts(spark, raw).first()[0] == len({p for p, _, _ in posts})
    assert jobs.count_malformed_posts(spark, raw).first()[0] == 4
    words = Counter(w for _, _, ws in posts for w in ws)
    assert jobs.count_unique_words(spark, raw).first()[0] == len(words)
    found = [tuple(r) for r in jobs.word_frequency_histogram(spark, raw).collect()]
    assert found == sorted(Counter(words.values()).items())
    users = Counter(u for _, u, _ in posts)
    found = [tuple(r) for r in jobs.user_post_histogram(spark, raw).collect()]
    assert found == sorted(Counter(users.values()).items(), reverse=True)


def test_informative_words(spark, corpus):
    found = jobs.informative_words(spark, corpus[1]["tagged"]).collect()
    assert {r["tag"] for r in found} == {"N"}
    assert [r["jsd"] for r in found] == sorted(r["jsd"] for r in found)


def test_cluster_predict_and_report(spark, corpus, tmp_path):
    posts, paths = corpus
    tagged = paths["tagged"]
    fitted = jobs.cluster_users(spark, tagged, k=2, min_posts=7, min_occurs=10, max_iter=10)
    for form in ("blocks", "lines"):
        path = str(tmp_path / form)
        write_centers(fitted.centers, path, form)
        centers = read_centers(spark, path, form, k=2)
        members = jobs.predict_users(spark, tagged, centers, min_posts=7, min_occurs=10)
        found = {r["user_id"]: r["cid"] for r in members.collect()}
        active = {u for u, n in Counter(u for _, u, _ in posts).items() if n >= 7}
        assert found.keys() == active
        assert len({(u % 2, c) for u, c in found.items()}) == 2
    tokens, users = jobs.analyze_clusters(spark, tagged, centers, min_posts=7, min_occurs=10, n=3)
    letters = {(r["cid"], r["token"][0]) for r in tokens.collect()}
    assert len(letters) == 2
    assert all(r["user_name"] == f"n{r['user_id']}" for r in users.collect())
    assert users.count() == 6


def test_predict_on_other_posts(spark, corpus, tmp_path):
    """Saved words make the indices of saved centres mean the same for any posts."""
    _, paths = corpus
    fitted = jobs.cluster_users(spark, paths["tagged"], k=2, min_posts=7, min_occurs=10, max_iter=10)
    path = str(tmp_path / "centers")
    write_centers(fitted.centers, path)
    write_vocabulary(fitted.vocabulary, path)
    words, tags = ["0early"] * 30 + ["b0", "b1"] * 20, "V"
    body = '{"id":1,"user":{"id":99}}'
    with open(tmp_path / "other", "w") as out:
        out.writelines(f"{' '.join(words)}\t{tags}\t0\t{body}\n" for _ in range(8))
    centers = read_centers(spark, path)
    found = jobs.predict_users(spark, [str(tmp_path / "other")], centers, 7, 10, read_vocabulary(spark, path))
    everyone = jobs.predict_users(spark, paths["tagged"], centers, 7, 10, read_vocabulary(spark, path))
    (cluster,) = {r["cid"] for r in everyone.collect() if r["user_id"] is not None and r["user_id"] % 2}
    assert [r["cid"] for r in found.collect() if r["user_id"] == 99] == [cluster]
    assert read_vocabulary(spark, str(tmp_path / "nothing")) is None


def test_word_histogram_is_whole(spark, tmp_path):
    """More than a thousand different counts, all of them reported."""
    with open(tmp_path / "posts", "w") as out:
        for n in range(1, 1101):
            out.write(json.dumps({"id": n, "user": {"id": 1}, "text": f"w{n} " * n}) + "\n")
    assert jobs.word_frequency_histogram(spark, [str(tmp_path / "posts")]).count() == 1100
    assert jobs.word_frequency_histogram(spark, [str(tmp_path / "posts")], limit=10).count() == 10


def test_no_files(spark):
    assert jobs.count_unique_words(spark, []).first()[0] == 0
    assert jobs.informative_words(spark, []).count() == 0
    assert jobs.cluster_users(spark, [], k=3).centers.count() == 0


def read_report(path):
    lines = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name)) as lines_in:
                lines += lines_in.read().splitlines()
    return lines


def test_command_line(spark, corpus, tmp_path):
    posts, paths = corpus
    out = str(tmp_path / "out")
    prefix = paths["raw"][0][:-1]
    for at, path in enumerate(paths["raw"]):
        os.link(path, f"{prefix}{at:02d}")
    main(["user-histogram", "--output", out, "--numbered", prefix, "0", "1"])
    users = Counter(u for _, u, _ in posts)
    expected = sorted(Counter(users.values()).items(), reverse=True)
    assert read_report(out) == [f"{n}\t{keys}" for n, keys in expected]

    limits = ["--min-posts", "7", "--min-occurs", "10"]
    centers = str(tmp_path / "centers")
    main(["cluster-users", "--output", centers, "--form", "lines", "--k", "2", *limits, *paths["tagged"]])
    main(["predict-users", "--output", out, "--centers", centers, "--form", "lines", *limits, *paths["tagged"]])
    members = [tuple(map(int, line.split("\t"))) for line in read_report(out)]
    assert members == sorted(members) and len(members) == sum(n >= 7 for n in users.values())
    main(["analyze-clusters", "--output", out, "--centers", centers, "--form", "lines", *limits, *paths["tagged"]])
    assert all(line.count("\t") == 3 for line in read_report(f"{out}/tokens"))
    assert len(read_report(f"{out}/users")) == len(members)


def test_every_job_tells_its_counts(spark, corpus, tmp_path, capsys):
    posts, paths = corpus
    active = sum(n >= 7 for n in Counter(u for _, u, _ in posts).values())
    words = Counter(w for _, _, ws in posts for w in ws)
    histogram = Counter(Counter(u for _, u, _ in posts).values())
    centers, limits = str(tmp_path / "centers"), ["--min-posts", "7", "--min-occurs", "10"]
    expected = {
        "unique-posts": "1 rows",
        "malformed-posts": "1 rows",
        "unique-words": "1 rows",
        "user-histogram": f"{len(histogram)} rows, {sum(histogram.values())} users",
        "word-histogram": f"{len(set(words.values()))} rows, {len(words)} words",
        "informative-words": f"{len({w for w in words if w[0] == 'a'})} rows",
        "cluster-users": f"2 rows, {active} users",
        "predict-users": f"{active} rows, {active} users",
        "analyze-clusters": f"{len(words)} tokens, {active} users",
    }
    for job, told in expected.items():
        kind = "raw" if job in ("unique-posts", "malformed-posts", "unique-words", "user-histogram", "word-histogram") else "tagged"
        out = centers if job == "cluster-users" else str(tmp_path / job)
        main([job, "--output", out, "--centers", centers, "--k", "2", *limits, *paths[kind]])
        assert capsys.readouterr().out.strip().splitlines()[-1] == told


def test_fit_tells_its_users(spark, corpus):
    posts, paths = corpus
    active = sum(n >= 7 for n in Counter(u for _, u, _ in posts).values())
    assert jobs.cluster_users(spark, paths["tagged"], k=2, min_posts=7, min_occurs=10).users == active
    assert jobs.cluster_users(spark, [], k=3).users == 0


def test_jobs_leave_little_on_disk(spark, corpus):
    """Counts of authors' words go once they are used, and parsed posts are not kept beside them."""
    folder = shared_folder(spark).removeprefix("file:")
    before, tagged = set(os.listdir(folder)), corpus[1]["tagged"]
    fitted = jobs.cluster_users(spark, tagged, k=2, min_posts=7, min_occurs=10, max_iter=2)
    tokens, users = jobs.analyze_clusters(spark, tagged, fitted.centers, min_posts=7, min_occurs=10, n=3, vocabulary=fitted.vocabulary)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"terms", "vectors", "posts"} and {"centers", "predictions"} <= left
    assert tokens.count() == 6 and users.count() == 6


def test_post_files_are_compressed(spark):
    lines = spark.createDataFrame([(f"word{i % 7} " * 50,) for i in range(300)], "value string")
    paths = job_queries._files(lines)
    names = [x for path in paths for x in os.listdir(path.removeprefix("file:")) if x.startswith("part-")]
    assert names and all(x.endswith(".gz") for x in names)
    assert sorted(r.value for r in read_lines(spark, paths).collect()) == sorted(r.value for r in lines.collect())


def test_staged_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a written plan go with it, and the session's settings are as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(key), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = manager.shuffleStatuses().size()
    staged = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().orderBy("k"))
    assert [r["count"] for r in staged.collect()] == [143] * 6 + [142]
    assert manager.shuffleStatuses().size() <= known and spark.conf.get(key) == before

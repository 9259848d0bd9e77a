import random
from collections import Counter, defaultdict

from postlytics.operators import profiles
from postlytics.operators.profiles import active_users, build_profiles, user_term_weights, user_vectors


def make_posts(seed=1):
    rng = random.Random(seed)
    rows = []
    for user in range(12):
        for _ in range(rng.randint(1, 8)):
            rows.append((user, [f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randint(0, 7))]))
    rows += [(100, ["only-me"])] * 3 + [(101, [])] * 4
    rows += [(None, ["w1"])] * 9
    return rows


def as_df(spark, rows):
    return spark.createDataFrame(rows, "user_id long, tokens array<string>")


def expected(rows, min_posts, min_occurs):
    n = Counter(u for u, _ in rows if u is not None)
    users = {u: c for u, c in n.items() if c >= min_posts}
    terms = defaultdict(Counter)
    for user, tokens in rows:
        if user in users:
            terms[user].update(tokens)
    totals = sum(terms.values(), Counter())
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in totals.items() if c >= min_occurs))}
    weights = {
        (u, vocabulary[w]): c / users[u] for u, counts in terms.items() for w, c in counts.items() if w in vocabulary
    }
    return users, vocabulary, weights


def test_profiles(spark):
    rows = make_posts()
    users, vocabulary, weights = expected(rows, 3, 5)
    df = as_df(spark, rows)
    found = build_profiles(df, 3, 5)
    assert {r["user_id"]: r["n_posts"] for r in found.users.collect()} == users
    assert {r["user_id"]: r["n_posts"] for r in active_users(df, 3).collect()} == users
    assert {r["token"]: r["idx"] for r in found.vocabulary.collect()} == vocabulary
    assert found.size == len(vocabulary)
    assert {(r["user_id"], r["idx"]): r["weight"] for r in user_term_weights(found).collect()} == weights


def test_vectors_keep_every_active_user_and_index_zero(spark):
    rows = make_posts(2)
    users, _, weights = expected(rows, 3, 5)
    vectors = user_vectors(build_profiles(as_df(spark, rows), 3, 5)).collect()
    assert {r["user_id"]: r["n_posts"] for r in vectors} == users
    found = {(r["user_id"], i): w for r in vectors for i, w in zip(r["indices"], r["values"])}
    assert found == weights
    assert any(i == 0 for _, i in found)
    by_user = {r["user_id"]: r for r in vectors}
    assert by_user[100]["indices"] == [] and by_user[101]["values"] == []
    assert all(r["indices"] == sorted(r["indices"]) for r in vectors)


def test_user_zero_is_a_user(spark):
    found = build_profiles(as_df(spark, [(0, ["a"])] * 7), 7, 1)
    assert [tuple(r) for r in found.users.collect()] == [(0, 7)]


def test_index_spans_many_parts(spark):
    words = spark.range(5000).selectExpr("concat('w', id) AS token", "id AS occurs")
    found = profiles.dense_index(words).collect()
    assert {r["token"]: r["idx"] for r in found} == {w: i for i, w in enumerate(sorted(f"w{i}" for i in range(5000)))}
    assert all(r["token"] == f"w{r['occurs']}" for r in found)


def test_large_vocabulary_joins_without_hint(spark, monkeypatch):
    rows = make_posts(3)
    _, _, weights = expected(rows, 3, 5)
    monkeypatch.setattr(profiles, "BROADCAST_TERMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = user_term_weights(build_profiles(as_df(spark, rows), 3, 5))
        assert {(r["user_id"], r["idx"]): r["weight"] for r in found.collect()} == weights
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nobody_active(spark):
    found = build_profiles(as_df(spark, [(1, ["a"])]), 7, 1)
    assert found.size == 0
    assert user_vectors(found).count() == 0


def test_an_author_with_a_third_of_the_posts(spark):
    """A bot's posts are counted before they meet the authors: its rows in the author join are its distinct words."""
    posts = [(1, ["a", "b", "a"])] * 400 + [(u, ["a", f"w{u}"]) for u in range(2, 202) for _ in range(4)] + [(None, ["a"])]
    df = spark.createDataFrame(posts, "user_id long, tokens array<string>").repartition(4)
    users = profiles.active_users(df, 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = profiles.user_token_counts(df, users)
        text = found._jdf.queryExecution().executedPlan().toString()
        rows = {(r["user_id"], r["token"]): (r["n_posts"], r["occurs"]) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows[1, "a"] == (400, 800) and rows[1, "b"] == (400, 400)
    assert rows[2, "a"] == (4, 4) and len(rows) == 2 + 2 * 200 and (None, "a") not in rows
    # The posts' side: filter by broadcast, spread, count by author and word, and only then the author join.
    counted = text.index("partial_count(1)")
    assert text.index("SortMergeJoin") < text.index("hashpartitioning(user_id") < counted < text.index("Generate explode")
    assert "BroadcastHashJoin" in text[text.index("Generate explode") :]


def test_other_authors_words_are_not_spread_out(spark):
    posts = spark.createDataFrame([(u, ["a", "b"]) for u in range(1000)] + [(7, ["c"])], "user_id long, tokens array<string>")
    users = profiles.active_users(posts, 2)
    found = profiles.user_token_counts(posts, users)
    assert sorted(map(tuple, found.collect())) == [(7, 2, "a", 1), (7, 2, "b", 1), (7, 2, "c", 1)]

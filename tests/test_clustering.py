import pickle
import random

import numpy as np
import pytest

from postlytics.functions import nearest
from postlytics.operators import clustering
from postlytics.operators.clustering import assign, center_entries, fit, lloyd_step, sample_centers
from postlytics.sources import staging
from postlytics.operators.reports import cluster_members, cluster_sizes, cluster_top_tokens, cluster_top_users

WIDTH = 8


def make_points(seed=1, n=60):
    rng = random.Random(seed)
    points = {}
    for user in range(n):
        entries = {i: rng.randint(1, 9) / rng.randint(7, 12) for i in range(WIDTH) if rng.random() < 0.4}
        points[user] = {} if user % 10 == 0 else entries
    return points


def vectors_of(spark, points):
    rows = [(u, 7 + u % 5, sorted(p), [p[i] for i in sorted(p)]) for u, p in points.items()]
    return spark.createDataFrame(rows, "user_id long, n_posts long, indices array<int>, values array<double>")


def centers_of(spark, centers):
    rows = [(c, sorted(p), [p[i] for i in sorted(p)]) for c, p in enumerate(centers)]
    return spark.createDataFrame(rows, "cid int, indices array<int>, values array<double>")


def dense(point):
    out = np.zeros(WIDTH)
    for i, v in point.items():
        out[i] = v
    return out


def expected_assign(points, centers):
    found = {}
    for user, point in points.items():
        distances = [round(float(((dense(point) - c) ** 2).sum()), 12) for c in centers]
        found[user] = (int(np.argmin(distances)), min(distances))
    return found


def expected_step(points, centers):
    labels = {u: c for u, (c, _) in expected_assign(points, centers).items()}
    new = [c.copy() for c in centers]
    for cid in set(labels.values()):
        new[cid] = np.mean([dense(points[u]) for u, c in labels.items() if c == cid], axis=0)
    moved = sum(((a - b) ** 2).sum() for a, b in zip(new, centers))
    return new, moved


def assigned(df):
    return {r["user_id"]: (r["cid"], r["distance2"]) for r in df.collect()}


def as_matrix(centers, k):
    out = np.zeros((k, WIDTH))
    for r in center_entries(centers).collect():
        out[r["cid"], r["idx"]] = r["value"]
    return out


def same(found, expected):
    assert found.keys() == expected.keys()
    for user, (cid, distance) in expected.items():
        assert found[user][0] == cid and abs(found[user][1] - distance) < 1e-9


@pytest.fixture(params=[1, 16_000_000])
def blocks(request, monkeypatch):
    """Centres sent one by one, and all at once."""
    monkeypatch.setattr(clustering, "BROADCAST_COORDINATES", request.param)


def test_assign(spark, blocks):
    points = make_points()
    starts = [points[3], points[7], {}, points[12]]
    found = assign(vectors_of(spark, points), centers_of(spark, starts))
    same(assigned(found), expected_assign(points, [dense(c) for c in starts]))
    assert found.columns == ["user_id", "n_posts", "indices", "values", "cid", "distance2"]


def test_ties_go_to_the_lowest_id(spark, blocks):
    points = {1: {0: 1.0}, 2: {}, 3: {1: 2.0}}
    found = assign(vectors_of(spark, points), centers_of(spark, [{5: 9.0}, {0: 1.0}, {0: 1.0}, {1: 2.0}]))
    assert {u: c for u, (c, _) in assigned(found).items()} == {1: 1, 2: 1, 3: 3}


def test_negative_coordinates_and_unknown_words(spark, blocks):
    points = {1: {0: 1.0, 7: 3.0}, 2: {1: 1.0}}
    centers = [{0: -1.0}, {1: -0.5}]
    found = assign(vectors_of(spark, points), centers_of(spark, centers))
    same(assigned(found), expected_assign(points, [dense(c) for c in centers]))


@pytest.mark.parametrize("scale", [0.1, 1.0, 1e2, 1e4])
def test_equally_far_centers_of_any_size(spark, blocks, scale):
    """Points of equal coordinates are as far from a centre as from its permutations."""
    rng = np.random.default_rng(5)
    points = {u: {i: float(x) for i in range(6)} for u, x in enumerate(rng.uniform(0.5, 1.5, 100) * scale)}
    center = rng.uniform(0, 1, 6) * scale
    starts = [dict(enumerate(map(float, rng.permutation(center)))) for _ in range(3)]
    found = assigned(assign(vectors_of(spark, points), centers_of(spark, starts)))
    assert {cid for cid, _ in found.values()} == {0}


def test_a_million_words(spark, monkeypatch):
    """What is sent grows with the non-zero coordinates, not with the vocabulary, and steps are cut without loss."""
    rng = np.random.default_rng(12)
    sparse = [{int(i): float(v) for i, v in zip(rng.integers(0, 1_000_000, 40), rng.normal(size=40))} for _ in range(30)]
    points = {u: {**dict(list(sparse[u % 30].items())[: u % 25]), **({999_999: 0.5} if u % 3 else {})} for u in range(80)}
    centers = centers_of(spark, sparse)
    shape = clustering._shape(centers)
    sent = sum(len(pickle.dumps(clustering._center_block(centers, *ends))) for ends in shape.blocks)
    assert sent < 40 * sum(map(len, sparse)) + 2000

    def distance(p, c):
        return sum((p.get(i, 0.0) - c.get(i, 0.0)) ** 2 for i in {*p, *c})

    expected = {u: min((round(distance(p, c), 9), cid) for cid, c in enumerate(sparse)) for u, p in points.items()}
    for cells, products in ((2_000_000, 4_000_000), (64, 50)):
        monkeypatch.setattr(nearest, "_CELLS", cells)
        monkeypatch.setattr(nearest, "_PRODUCTS", products)
        found = assigned(assign(vectors_of(spark, points), centers))
        assert {u: (round(d, 9), cid) for u, (cid, d) in found.items()} == expected


def test_no_centers(spark):
    with pytest.raises(ValueError, match="no centres"):
        assign(vectors_of(spark, {1: {0: 1.0}}), centers_of(spark, [{}]).limit(0))


def test_fit_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: str(tmp_path))
    found = fit(vectors_of(spark, make_points(1)), k=3, tol=0.0, max_iter=4)
    assert len(list(tmp_path.iterdir())) == 1 and found.centers.count() == 3


def test_all_centers_zero(spark):
    found = assign(vectors_of(spark, {1: {0: 2.0}, 2: {}}), centers_of(spark, [{}, {}]))
    assert assigned(found) == {1: (0, 4.0), 2: (0, 0.0)}


def test_step(spark):
    points = make_points(3)
    starts = [points[3], points[7], points[11]]
    found = lloyd_step(vectors_of(spark, points), centers_of(spark, starts))
    expected, moved = expected_step(points, [dense(c) for c in starts])
    assert np.allclose(as_matrix(found, 3), expected)
    rows = found.collect()
    assert sum(r["size"] for r in rows) == len(points)
    assert abs(sum(r["moved"] for r in rows) - moved) < 1e-9


def test_empty_cluster_keeps_its_center(spark):
    points = {1: {0: 1.0}, 2: {0: 1.2}}
    starts = [{0: 1.0}, {3: 50.0, 4: 1.0}, {}]
    found = {r["cid"]: r for r in lloyd_step(vectors_of(spark, points), centers_of(spark, starts)).collect()}
    assert (found[1]["size"], found[1]["indices"], found[1]["values"], found[1]["moved"]) == (0, [3, 4], [50.0, 1.0], 0.0)
    assert (found[2]["size"], found[2]["indices"]) == (0, [])
    assert abs(found[0]["moved"] - 0.01) < 1e-9


def test_zero_vectors_count_in_the_mean(spark):
    found = lloyd_step(vectors_of(spark, {1: {0: 1.0}, 2: {}}), centers_of(spark, [{}])).first()
    assert (found["size"], found["values"]) == (2, [0.5])


def test_fit_follows_the_rounds(spark):
    points = make_points(4)
    vectors = vectors_of(spark, points)
    starts = [points[i] for i in (1, 2, 3, 4)]
    current, objective = [dense(c) for c in starts], []
    for _ in range(3):
        objective.append(sum(d for _, d in expected_assign(points, current).values()))
        current, moved = expected_step(points, current)
    result = fit(vectors, centers=centers_of(spark, starts), tol=0.0, max_iter=3)
    assert np.allclose(as_matrix(result.centers, 4), current)
    assert result.iterations <= 3 and abs(result.delta - moved) < 1e-9
    assert objective == sorted(objective, reverse=True)


def test_fit_stops(spark):
    points = make_points(5)
    vectors = vectors_of(spark, points)
    loose = fit(vectors, k=3, tol=0.9, max_iter=10)
    assert loose.iterations == 10 or loose.delta <= 0.9
    tight = fit(vectors, k=3, tol=0.0, max_iter=30)
    assert tight.delta == 0.0 and tight.iterations < 30
    assert fit(vectors, k=3, max_iter=0).iterations == 0


def test_sample_is_drawn_without_replacement(spark):
    vectors = vectors_of(spark, make_points(6))

    def drawn(vectors, **more):
        return sample_centers(vectors, 5, **more).orderBy("cid").collect()

    first = drawn(vectors)
    assert [r["cid"] for r in first] == list(range(5))
    assert first == drawn(vectors.repartition(5))
    assert first != drawn(vectors, seed="other")
    assert sample_centers(vectors, 100).count() == 60


def test_reports(spark):
    points = {u: {0: 1.0 + u / 100} for u in range(6)} | {10: {1: 5.0}}
    vectors = vectors_of(spark, points)
    centers = centers_of(spark, [{0: 1.0, 2: 1.0, 3: 1.0}, {1: 5.0, 0: 0.5}, {7: 99.0}])
    predictions = assign(vectors, centers)
    assert {r["cid"]: r["size"] for r in cluster_sizes(predictions, centers).collect()} == {0: 6, 1: 1, 2: 0}
    members = {(r["cid"], r["user_id"]) for r in cluster_members(predictions, centers).collect()}
    assert members == {(0, u) for u in range(6)} | {(1, 10), (2, None)}

    vocabulary = spark.createDataFrame([(f"t{9 - i}", i) for i in range(WIDTH)], "token string, idx int")
    tokens = cluster_top_tokens(centers, vocabulary, 2).collect()
    assert {(r["cid"], r["rank"], r["token"], r["weight"]) for r in tokens} == {
        (0, 1, "t6", 1.0),
        (0, 2, "t7", 1.0),
        (1, 1, "t8", 5.0),
        (1, 2, "t9", 0.5),
        (2, 1, "t2", 99.0),
    }

    posts = spark.createDataFrame(
        [(u, name, "d") for u in points for name in (f"n{u}", f"m{u}")],
        "user_id long, user_name string, user_description string",
    )
    users = cluster_top_users(predictions, posts, 2).collect()
    assert {(r["cid"], r["rank"], r["user_id"], r["n_posts"], r["user_name"]) for r in users} == {
        (0, 1, 4, 11, "m4"),
        (0, 2, 3, 10, "m3"),
        (1, 1, 10, 7, "m10"),
    }


def test_top_users_of_a_large_cluster(spark):
    predictions = spark.range(5000).selectExpr("cast(0 AS int) AS cid", "id AS user_id", "id % 100 AS n_posts")
    posts = spark.range(5000).selectExpr("id AS user_id", "'n' AS user_name", "'d' AS user_description")
    found = cluster_top_users(predictions, posts, 3).orderBy("rank").collect()
    assert [(r["rank"], r["user_id"], r["n_posts"]) for r in found] == [(1, 99, 99), (2, 199, 99), (3, 299, 99)]

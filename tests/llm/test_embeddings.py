import numpy as np
import pytest

from postlytics.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n int, id string"


def slow_links(rows, cosine=0.95):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = [
        (i, j)
        for a, (i, x) in enumerate(good)
        for j, y in good[:a]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    ]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in range(40):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (links[i], root[i], root[i] == i) for i, _ in rows}


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 30)):
            rows.append((base + rng.normal(size=8) * rng.choice([0, 0.02, 0.25])).astype(np.float32).tolist())
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e30] * 8, [2e30] * 8, [1.0, 1.0], [2.0, 2.1]]
    rows += odd
    ids = rng.permutation(len(rows)) + (1 << 53)
    return [(int(i), r) for i, r in zip(ids, rows)]


@pytest.mark.parametrize(("seed", "shard", "largest"), [(1, 300, 4096), (2, 20, 4096), (3, 100, 16)])
def test_same_as_comparing_all(spark, monkeypatch, seed, shard, largest):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    monkeypatch.setattr(embeddings, "LARGEST", largest)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(df).collect()}
    expected = slow_links(rows)
    assert found.keys() == expected.keys()
    assert all(found[i][0] <= expected[i][0] for i in found)
    assert sum(x[0] for x in found.values()) >= 0.97 * sum(x[0] for x in expected.values())
    if shard == 300 and largest == 4096:
        assert found == expected


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.link_vectors(none).count() == 0
    rows = [(3, [1.0, 0.0])] * 2 + [(None, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], SCHEMA)
    found = sorted(map(str, embeddings.link_vectors(df).select("vec_id", "n_links", "component_id").collect()))
    assert found == sorted(
        ["Row(vec_id=3, n_links=2, component_id=3)"] * 2 + ["Row(vec_id=None, n_links=2, component_id=3)", "Row(vec_id=4, n_links=0, component_id=4)"]
    )


def test_a_crowd_does_not_hide_lost_pairs(spark):
    """A crowd of 200 with all its links beside 100 pairs that were all lost."""
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=16) + rng.normal(size=(200, 16)) * 1e-3
    middles = rng.normal(size=(100, 16))
    x = np.concatenate([crowd, middles, middles + 1e-3])
    same = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "id long, n long, x array<double>")
    links = {True: [199] * 200 + [1] * 200, False: [199] * 200 + [0] * 200}
    for whole, counts in links.items():
        found = spark.createDataFrame(list(enumerate(counts)), "id long, links long")
        assert embeddings.audit_recall(same, found, 16) == (1.0 if whole else 0.5)


def test_every_search_is_audited(spark, monkeypatch):
    """The last one too; what it misses is an error and no result."""
    audits = []
    monkeypatch.setattr(embeddings, "audit_recall", lambda *a: audits.append(a) or 0.89)
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in vectors(6)[:40]], SCHEMA)
    with pytest.raises(RuntimeError, match="12 shards"):
        embeddings.link_vectors(df)
    assert len(audits) == 3


def shard(seed):
    """400 single rows, 100 pairs and a crowd of 150, whose members all link."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(100, 32))
    crowd = rng.normal(size=32) + rng.normal(size=(150, 32)) * 0.05
    x = embeddings._unit(np.concatenate([rng.normal(size=(400, 32)), middles, middles + rng.normal(size=(100, 32)) * 0.05, crowd]))
    return x[rng.permutation(len(x))].astype(np.float32)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_a_graph_finds_what_comparing_all_finds(seed):
    x = shard(seed)
    graph = embeddings.build_graph(x, np.zeros(len(x)))
    assert graph.shape == (len(x), embeddings.DEGREE * 3 // 2)
    for at, row in enumerate(graph):
        row = row[row >= 0]
        assert len(row) and at not in row and len(set(row)) == len(row)
    a, b = embeddings.search_range(x, np.zeros(len(x)), graph, float(np.arccos(0.95)))
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    close = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)}
    assert len(found) == len(a) and all(i < j for i, j in found)
    assert len(close) > 11_000 and len(found & close) >= 0.999 * len(close)
    assert all(x[i] @ x[j] >= 0.95 - 1e-4 for i, j in found)


def test_rows_of_wide_balls_are_found():
    """A ball at twice the angle whose members reach into the range."""
    turn = np.array([0.0, 0.6, 0.3, 1.2])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1).astype(np.float32)
    radius = np.array([0.0, 0.29, 0.0, 0.0])
    a, b = embeddings.search_range(x, radius, embeddings.build_graph(x, radius), float(np.arccos(0.95)))
    assert list(zip(a, b, strict=True)) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_pruned_lists():
    turn = np.array([0.0, 0.1, 0.12, -0.2, 0.0])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    near = np.array([[1, 2, 3, 0, 1, -1]])
    assert embeddings.robust_prune(x, np.array([0]), near, 3).tolist() == [[1, 3, -1]]
    assert embeddings.robust_prune(x, np.array([0]), near[:, :0], 3).tolist() == [[-1] * 3]
    one = embeddings.build_graph(x[:1], np.zeros(1))
    assert (one == -1).all() and embeddings.search_range(x[:1], np.zeros(1), one, 0.3)[0].tolist() == []

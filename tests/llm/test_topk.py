"""Top-k and hard negatives against brute force, with odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlytics.llm import negatives, topk, vectors

COLUMNS = "vec_id long, embedding array<double>, label int, x string, rank int, q long, block long"
EXTRA = ("x", 1, 2, 3)


def odd_vectors(seed, n=160, width=7, clusters=5):
    """Clustered vectors with ties, copies, repeated rows and ids, NULLs, non-finite components and unequal lengths."""
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        at = rng.randrange(clusters)
        vector = [m + rng.gauss(0, 0.05) for m in middle[at]] if rng.random() < 0.7 else list(middle[at])
        rows.append((i * 5, vector, rng.randrange(3)))
    rows += [rows[0], rows[0], (rows[3][0], rows[8][1], 1)]
    rows += [(1000 + 100 * i, v, 1) for i, v in enumerate([None, [], [0.0] * width, [1.0, None], [1.0, math.nan], [math.inf], [0.5, 0.5], [9.0] * width])]
    rows += [(None, [0.3] * width, 1), (None, [0.3] * width, 2), (2100, [0.3] * width, None), (-100, [0.9] * width, 0)]
    rng.shuffle(rows)
    return rows


def usable(rows, scale, labelled=False):
    out = []
    for vec_id, vector, label in rows:
        if vector is None or any(e is None or not math.isfinite(e) for e in vector) or (labelled and label is None):
            continue
        out.append((vec_id, tuple(math.floor(scale * e) for e in vector), label))
    return out


def dot(a, b):
    return sum(p * q for p, q in zip(a, b))


def padded(x, width):
    return x + (0,) * (width - len(x))


def first(scored, k):
    return sorted(scored, key=lambda e: (-e[0], e[1] is None, e[1] or 0))[:k]


def ranked_by_brute_force(queries, rows, k, scale):
    out = []
    rows, width = usable(rows, scale), max(len(v or ()) for _, v, _ in rows)
    for query_id, x in {(i, padded(x, width)) for i, x, _ in usable(queries, scale)}:
        scored = [(dot(x, y), i) for i, y, _ in rows if i != query_id]
        out += [(query_id, r + 1, i, s) for r, (s, i) in enumerate(first(scored, k))]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,ring", [(1, 8), (2, 1)])
def test_top_k(spark, monkeypatch, seed, ring):
    rows = odd_vectors(seed)
    monkeypatch.setattr(topk, "RING", ring)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], COLUMNS)
    found = topk.nearest(table.filter(F.col("vec_id") % 20 == 0), table, 6)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    assert sorted(map(tuple, found.collect()), key=str) == ranked_by_brute_force(queries, rows, 6, 64)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in topk.nearest(table.filter("vec_id = 0"), table).collect()] == [(0, 1, 1, 64 * 128)]
    none = table.filter("vec_id > 5")
    assert topk.nearest(none, none).count() == 0 and topk.nearest(none, table).count() == 0 and topk.nearest(table, none).count() == 0
    assert negatives.mine(none, F.lit(True)).count() == 0 and negatives.mine(table, F.lit(True)).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(0, [2.0**25, 3.0], 0), (1, [2.0**25, 1.0], 0), (2, [2.0**25, 1.015625], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = [tuple(r) for r in topk.nearest(table.filter("vec_id = 0"), table).collect()]
    assert found == [(0, 1, 2, 2**62 + 192 * 65), (0, 2, 1, 2**62 + 192 * 64)]


def test_far_annuli_are_not_read(spark):
    """Two clusters far apart: the bounds of the other one's annuli rule it out."""
    rng = np.random.default_rng(3)
    near, far = (rng.normal(m, 0.01, (50, 4)) for m in ([4, 0, 0, 0], [0, 4, 0, 0]))
    length, to_pivot = np.array([256.0]), np.array([256.0 * math.sqrt(2)])
    assert topk.bound(length, to_pivot, 0.0, 4.0, 260.0)[0] < 64 * 64 * (near @ near.T).min()
    assert topk.bound(length, np.array([1.0]), 0.0, 4.0, 260.0)[0] >= 64 * 64 * (near @ near.T).min()
    assert (64 * 64 * (near @ far.T) <= topk.bound(length, to_pivot - 8, 0.0, 8.0, 260.0)[0]).all()


def mined_by_brute_force(rows, anchors, scale):
    out = []
    rows, width = usable(rows, scale, labelled=True), max(len(v or ()) for _, v, _ in rows)
    for anchor_id, x, label in {(i, padded(x, width), y) for i, x, y in rows if anchors(i)}:
        same = [(dot(x, y), i) for i, y, other in rows if other == label and i != anchor_id]
        other = [(dot(x, y), i) for i, y, other in rows if other != label]
        for positive, positive_id in first(same, 5):
            inside = [(s, i) for s, i in other if 50 * positive <= 100 * s <= 95 * positive]
            out += [(anchor_id, positive_id, r + 1, i, positive, s) for r, (s, i) in enumerate(first(inside, 3))]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,group", [(4, 1024), (5, 8)])
def test_hard_negatives(spark, monkeypatch, seed, group):
    rows = odd_vectors(seed)
    monkeypatch.setattr(negatives, "ANCHORS", group)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], COLUMNS)
    found = negatives.mine(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == mined_by_brute_force(rows, lambda i: i is not None and i % 50 == 0, 256)


@pytest.mark.parametrize("width", [1, 5, 16, 37])
def test_segment_bounds(width):
    """Every level's bounds hold, and finer ones are not wider."""
    rng = np.random.default_rng(width)
    a, b = np.floor(rng.normal(3, 50, (20, width))), np.floor(rng.normal(-2, 9, (30, width)))
    score, before = a @ b.T, None
    for one, two in zip(negatives._levels(a), negatives._levels(b), strict=True):
        low, high = negatives.bounds(one, two)
        assert (low <= score).all() and (score <= high).all()
        if before is not None:
            assert (high - low <= before + 1e-6 * np.abs(before)).all()
        before = high - low
    kind = vectors.Shape(width, "f8", True)
    alive = negatives.filtered(negatives._levels(a), negatives._levels(b), np.ones(score.shape, dtype=bool), lambda row, lo, hi: hi >= 0)
    assert alive[score >= 0].all()
    assert (negatives.exact(a, b, alive, kind)[alive] == score[alive]).all()

"""Hard negatives by segment summaries that bound inner products.

A vector is cut into segments; of each its mean and its deviation (the length of
what is left when the mean is taken off) are stored. Over a segment of n
components the inner product of two vectors lies within the product of the
deviations of n times the product of the means, so sums over segments bound a score
from both sides. Summaries of neighbouring segments merge exactly into those of
the longer segment that they make, so that a search starts from one segment and halves
segments only for pairs that the bounds so far cannot settle. What is left
after the last level is scored exactly.

Anchors are dealt into groups of bounded size, rows into blocks; each cell of the
grid of groups and runs of blocks is one unit of work, streamed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlytics.llm import vectors
from postlytics.llm.vectors import Found, Shape
from postlytics.sources.staging import cut_lineage, free

#: Segments of each level.
LEVELS = (1, 4, 16)
#: Anchors in a group, on average.
ANCHORS = 1024
#: Share of pairs left from which a level goes through whole tables instead of single pairs.
DENSE = 0.25
#: Room for rounding in bounds, as a share of the product of two lengths.
SLACK = 1e-5


class Summary(NamedTuple):
    """Of each vector (row) and segment (column) n times the mean over its root, and the deviation; and each vector's length."""

    mean: np.ndarray
    deviation: np.ndarray
    length: np.ndarray

    def rows(self, at: np.ndarray) -> Summary:
        return Summary(self.mean[at], self.deviation[at], self.length[at])


def edges(width: int, segments: int) -> np.ndarray:
    """Ends of the segments of the finest level and so of every coarser one, which has each n-th of them."""
    return np.linspace(0, width, segments + 1).astype(int)


def summarize(x: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Sum and squared length of each segment of the finest level: what mean and deviation are made of."""
    cuts = edges(x.shape[1], levels[-1])
    sums, squares = (np.concatenate([np.zeros((len(x), 1)), np.cumsum(v, axis=1)], axis=1)[:, cuts] for v in (x, x * x))
    return np.diff(sums, axis=1), np.diff(squares, axis=1)


def level(sums: np.ndarray, squares: np.ndarray, width: int, segments: int) -> Summary:
    """The summary of fewer segments, merged from those of the finest level."""
    step = sums.shape[1] // segments
    size = np.diff(edges(width, sums.shape[1])[::step])
    total = sums.reshape(len(sums), segments, step).sum(axis=2)
    square = squares.reshape(len(sums), segments, step).sum(axis=2)
    # Segments without components have sums of zero.
    mean = total / np.sqrt(np.maximum(size, 1))
    return Summary(mean, np.sqrt(np.maximum(square - mean * mean, 0.0)), np.sqrt(square.sum(axis=1)))


def bounds(a: Summary, b: Summary, paired: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of each row of ``a`` with each of ``b``, or with that at its place."""
    if paired:
        middle, spread = (np.einsum("ij,ij->i", p, q) for p, q in ((a.mean, b.mean), (a.deviation, b.deviation)))
        room = SLACK * a.length * b.length + SLACK
    else:
        middle, spread = a.mean @ b.mean.T, a.deviation @ b.deviation.T
        room = SLACK * np.outer(a.length, b.length) + SLACK
    return middle - spread - room, middle + spread + room


def filtered(a: list[Summary], b: list[Summary], alive: np.ndarray, wanted) -> np.ndarray:
    """Pairs of ``alive`` (rows of a by rows of b) that no level's bounds rule out.

    ``wanted(row, low, high)`` says of pairs, given the rows of a, whether they may matter.
    """
    for one, two in zip(a, b, strict=True):
        if alive.mean() > DENSE:
            low, high = bounds(one, two)
            alive = alive & wanted(np.arange(len(alive))[:, None], low, high)
        else:
            row, at = np.nonzero(alive)
            alive = np.zeros_like(alive)
            left = wanted(row, *bounds(one.rows(row), two.rows(at), paired=True))
            alive[row[left], at[left]] = True
        if not alive.any():
            break
    return alive


def exact(a: np.ndarray, b: np.ndarray, alive: np.ndarray, kind: Shape) -> np.ndarray:
    """Scores of the pairs in ``alive``; others may be anything."""
    if alive.mean() > DENSE:
        return vectors.scores(a, b, kind)
    row, at = np.nonzero(alive)
    out = np.zeros(alive.shape, dtype=np.int64)
    step = 1 << 16
    for low in range(0, len(row), step):
        r, c = row[low : low + step], at[low : low + step]
        out[r, c] = vectors.pairwise(a[r], b[c], kind)
    return out


def _levels(x: np.ndarray, stored: tuple[bytes, bytes] | None = None) -> list[Summary]:
    if stored is None:
        sums, squares = summarize(x)
    else:
        sums, squares = (np.frombuffer(raw, dtype=np.float64).reshape(len(x), LEVELS[-1]) for raw in stored)
    return [level(sums, squares, x.shape[1], n) for n in LEVELS]


def _summarized(blocks: DataFrame, kind: Shape) -> DataFrame:
    """``blocks`` with the stored summaries of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [summarize(vectors.matrix(raw, kind)) for raw in batch.column("x").to_pylist()]
            stored = [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *stored], [*batch.schema.names, "sums", "squares"])

    return blocks.mapInArrow(run, "block long, n int, vec_id array<long>, label array<int>, x binary, sums binary, squares binary")


class _Anchors(NamedTuple):
    """A group of anchors: vectors, summaries, ids, labels, and scores of their positives if known."""

    group: int
    x: np.ndarray
    levels: list[Summary]
    id: np.ndarray
    none: np.ndarray
    label: np.ndarray
    positive: list[list[int]]


def _cells(anchors: DataFrame, blocks: DataFrame, groups: int, parts: int, visit, schema: str) -> DataFrame:
    """Run ``visit(anchors, blocks)`` on each cell: a group of anchors and a run of blocks."""
    runs = max(1, -(-parts // groups))
    both = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("order"), "vec_id", "label", "x", "sums", "squares"
    ).unionByName(
        anchors.select("group", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("order"), "vec_id", "label", "x", "positive"), allowMissingColumns=True
    )
    return both.repartition(parts, "group", "run").sortWithinPartitions("group", "run", "order").mapInArrow(visit, schema)


def _streamed(kind: Shape, start, step, end):
    """Function of a sorted partition: ``start(anchors)`` makes a state, ``step(anchors, state, x, levels, id, none, label)`` sees a block, ``end`` tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state = None
        for batch in batches:
            x, sums, squares = (batch.column(c).to_pylist() for c in ("x", "sums", "squares"))
            for at in range(batch.num_rows):
                rows = vectors.matrix(x[at], kind)
                id, none = vectors.ids(batch.column("vec_id")[at].values)
                label = batch.column("label")[at].values.to_numpy()
                if batch.column("order")[at].as_py() == 0:
                    if held is not None:
                        yield from end(held, state)
                    positive = batch.column("positive")[at].as_py() or [[] for _ in id]
                    held = _Anchors(batch.column("group")[at].as_py(), rows, _levels(rows), id, none, label, positive)
                    state = start(held)
                elif held is not None:
                    state = step(held, state, rows, _levels(rows, (sums[at], squares[at])), id, none, label)
        if held is not None:
            yield from end(held, state)

    return run


def _positives(kind: Shape, n: int):
    """Each anchor's best ``n`` other rows of its label, of one cell."""

    def step(held: _Anchors, state: Found, x, levels, id, none, label) -> Found:
        least = state.least(len(held.x), n)
        alive = (held.label[:, None] == label) & ((held.id[:, None] != id) | (held.none[:, None] != none))
        alive = filtered(held.levels, levels, alive, lambda row, low, high: high >= least[row])
        if not alive.any():
            return state
        score = exact(held.x, x, alive, kind)
        return state.joined(vectors.first_of(score, alive, n, id, none)).best(n)

    def end(held: _Anchors, state: Found) -> Iterator[pa.RecordBatch]:
        arrays = [pa.array(np.full(len(state.row), held.group, dtype=np.int32)), pa.array(state.row.astype(np.int32)), pa.array(state.id, mask=state.none), pa.array(state.score)]
        yield pa.RecordBatch.from_arrays(arrays, ["group", "at", "positive_id", "positive_score"])

    return _streamed(kind, lambda held: vectors.nothing_found(), step, end)


def _windows(held: _Anchors, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, positive score, least and most negative score of each distinct window that any whole number is in."""
    out = []
    for at, found in enumerate(held.positive):
        for score in sorted(set(found)):
            least, most = -(-low * score // 100), high * score // 100
            if least <= most:
                out.append((at, score, least, most))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 4


def _negatives(kind: Shape, n: int, low: int, high: int):
    """For each anchor and score of a positive the best ``n`` rows of other labels in its window, of one cell."""

    def start(held: _Anchors):
        windows = _windows(held, low, high)
        anchors, place = np.unique(windows[0], return_inverse=True)
        return windows, anchors, place, vectors.nothing_found()

    def step(held: _Anchors, state, x, levels, id, none, label):
        (anchor, _, least, most), anchors, place, found = state
        if not len(anchors):
            return state
        need = np.maximum(least, found.least(len(anchor), n))
        # For each anchor the widest range that one of its windows still wants.
        lowest, highest = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), np.iinfo(np.int64).min)
        np.minimum.at(lowest, place, need)
        np.maximum.at(highest, place, most)
        mine = [s.rows(anchors) for s in held.levels]
        alive = filtered(mine, levels, held.label[anchors][:, None] != label, lambda row, lo, hi: (hi >= lowest[row]) & (lo <= highest[row]))
        if not alive.any():
            return state
        score = exact(held.x[anchors], x, alive, kind)
        for first in range(0, len(anchor), 256):
            w = np.arange(first, min(first + 256, len(anchor)))
            table = score[place[w]]
            inside = alive[place[w]] & (table >= need[w, None]) & (table <= most[w, None])
            new = vectors.first_of(table, inside, n, id, none)
            found = found.joined(new._replace(row=w[new.row]))
        return state[0], anchors, place, found.best(n)

    def end(held: _Anchors, state) -> Iterator[pa.RecordBatch]:
        (anchor, positive, *_), _, _, found = state
        group = np.full(len(found.row), held.group, dtype=np.int32)
        arrays = [pa.array(group), pa.array(anchor[found.row].astype(np.int32)), pa.array(positive[found.row]), pa.array(found.id, mask=found.none), pa.array(found.score)]
        yield pa.RecordBatch.from_arrays(arrays, ["group", "at", "positive_score", "negative_id", "negative_score"])

    return _streamed(kind, start, step, end)


def mine(
    table: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``table`` (vec_id, embedding, label).

    A score is the exact inner product of ``floor(scale * x)``; higher ones come
    first, ties by smaller vec_id, NULL last. The positives of an anchor are its
    first rows of the same label and another vec_id; the negatives of an anchor and a
    positive its first rows of other labels that score ``low`` to ``high``
    per cent of the positive. Rows with a NULL label, a NULL vector or a NULL or
    non-finite component take no part; shorter vectors are continued by zeros. An
    anchor that repeats in id, label and vector is one, and its lists number rows
    that repeat apart; one that repeats in its id alone has lists for each.
    Fewer rows than asked give all there are, an empty table none; further
    columns are not read. A score beyond 64 bits is an error.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    rows = rows.filter(F.col("label").isNotNull() & vectors.is_finite(F.col("embedding")))
    kind = vectors.shape(rows, scale)
    keep = {"vec_id": "long", "label": "int"}
    whole = vectors.quantized(rows, kind, scale, keep)
    blocks = cut_lineage(_summarized(vectors.packed_blocks(whole, kind, keep), kind), "blocks")
    chosen = cut_lineage(whole.filter(is_anchor).distinct(), "anchors")
    groups = max(1, -(-chosen.count() // ANCHORS))
    entry = F.struct("vec_id", "label", "x")
    dealt = chosen.groupBy(F.pmod(F.xxhash64("vec_id", "x", "label"), F.lit(groups)).cast("int").alias("group"))
    dealt = dealt.agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    anchors = cut_lineage(dealt.select("group", "rows.vec_id", "rows.label", "rows.x"), "anchor-groups")

    order = Window.partitionBy("group", "at").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    none = anchors.withColumn("positive", F.lit(None).cast("array<array<bigint>>"))
    found = _cells(_joined_vectors(none), blocks, groups, parts, _positives(kind, positives), "group int, at int, positive_id long, positive_score long")
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    first = cut_lineage(first, "positives")

    listed = first.groupBy("group", "at").agg(F.collect_list("positive_score").alias("scores"))
    every = anchors.select("group", F.posexplode("vec_id").alias("at", "vec_id")).join(listed, ["group", "at"], "left")
    scores = every.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("at", "scores"))).alias("listed"))
    scores = scores.select("group", F.transform("listed", lambda e: F.coalesce(e["scores"], F.array().cast("array<bigint>"))).alias("positive"))
    visited = _cells(_joined_vectors(anchors.join(scores, "group")), blocks, groups, parts, _negatives(kind, negatives, low, high), "group int, at int, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("group", "at", "positive_score").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    mined = visited.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    names = anchors.select("group", F.posexplode("vec_id").alias("at", "anchor_id"))
    result = first.drop("place").join(mined, ["group", "at", "positive_score"]).join(names, ["group", "at"])
    result = cut_lineage(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for staged in (blocks, chosen, anchors, first):
        free(staged)
    return result


def _joined_vectors(anchors: DataFrame) -> DataFrame:
    """The list of packed vectors of each group as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([b"".join(v) for v in batch.column("x").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([x if c == "x" else batch.column(c) for c in names], names)

    names = ["group", "vec_id", "label", "x", "positive"]
    return anchors.select(*names).mapInArrow(run, "group int, vec_id array<long>, label array<int>, x binary, positive array<array<long>>")

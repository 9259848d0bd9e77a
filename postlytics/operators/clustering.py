"""Lloyd k-means over sparse author vectors.

Vectors are ``(user_id, n_posts, indices, values)`` and centres ``(cid, indices,
values)``, one row each.  Assigning a vector is narrow: centres travel to the
tasks as blocks of bounded size that hold their non-zero coordinates by word.  Only sums per centre and word are shuffled, after they
were combined in each task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlytics.functions.nearest import Block, make_block, nearest_center
from postlytics.functions.text import each
from postlytics.sources.staging import cut_lineage, cut_lineage_counted, free

# Non-zero coordinates in one block of centres that is sent to the tasks, of 12 bytes and one word's place: up to 240 MB.
BROADCAST_COORDINATES = 10_000_000
# Index of the constant entry that carries a count through a sum.
_UNIT = -1


class KMeansFit(NamedTuple):
    """centers (cid, size, indices, values); number of rounds; last total move; the words that indices mean, if known; number of users."""

    centers: DataFrame
    iterations: int
    delta: float
    vocabulary: DataFrame | None = None
    users: int | None = None


def sample_centers(vectors: DataFrame, k: int, seed: str = "") -> DataFrame:
    """``k`` vectors as centres, drawn without replacement by a hash of the author.

    Authors are drawn by id alone, so only the ``k`` chosen vectors move.
    """
    drawn = F.md5(F.concat(F.lit(seed), F.col("user_id").cast("string")))
    chosen = vectors.select("user_id", drawn.alias("drawn")).orderBy("drawn").limit(k)
    cid = F.row_number().over(Window.orderBy("drawn")) - 1
    numbered = chosen.select("user_id", cid.alias("cid"))
    return vectors.join(F.broadcast(numbered), "user_id").select("cid", "indices", "values")


def _entries(key: str, extra_indices: Column | None = None, extra_values: Column | None = None) -> list[Column]:
    """``key, idx, value`` for each entry of a vector and for the extra entries."""
    indices, values = F.col("indices"), F.col("values")
    if extra_indices is not None:
        indices, values = F.concat(indices, extra_indices), F.concat(values, extra_values)
    pairs = F.arrays_zip(indices.alias("idx"), values.alias("value"))
    return [F.col(key), F.inline(pairs).alias("idx", "value")]


def center_entries(centers: DataFrame) -> DataFrame:
    """``(cid, idx, value)`` for the non-zero coordinates."""
    return centers.select(*_entries("cid")).filter(F.col("value") != 0)


class _Shape(NamedTuple):
    """Of each block of centres the first and last id, and the centres' summed move if they moved."""

    blocks: list[tuple[int, int]]
    moved: float


def _shape(centers: DataFrame) -> _Shape:
    """Cut ``centers`` into runs of ids with a bounded number of non-zero coordinates; one short row a centre comes to the driver."""
    moved = F.col("moved") if "moved" in centers.columns else F.lit(0.0)
    blocks, left, total = [], 0, 0.0
    for cid, size, move in centers.select("cid", F.size("indices"), moved).sort("cid").collect():
        total += move
        if left >= size and blocks:
            blocks[-1] = (blocks[-1][0], cid)
            left -= size
        else:
            blocks.append((cid, cid))
            left = BROADCAST_COORDINATES - size
    return _Shape(blocks, total)


def _center_block(centers: DataFrame, first: int, last: int) -> Block:
    """The centres with ids ``first`` to ``last``."""
    found = centers.filter(F.col("cid").between(first, last)).select("cid", "indices", "values").toArrow().sort_by("cid").combine_chunks()
    indices, values = (found[name].combine_chunks() for name in ("indices", "values"))
    sizes, index, value = indices.value_lengths().to_numpy(), indices.flatten().to_numpy(), values.flatten().to_numpy()
    return make_block(found["cid"].to_numpy(), sizes, index, value)


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """Vectors with ``cid`` and ``distance2`` of their nearest centre, ties to the lowest id.

    Narrow whatever the centres' size: their non-zero coordinates are sent as blocks of
    bounded size, and one rule compares them all.
    """
    return _assign(vectors, centers, _shape(centers), [])


def _assign(vectors: DataFrame, centers: DataFrame, shape: _Shape, sent: list[Broadcast]) -> DataFrame:
    """``sent`` gets what was broadcast, for whoever knows when it is done with."""
    if not shape.blocks:
        raise ValueError("there are no centres")
    context = vectors.sparkSession.sparkContext
    blocks, largest = [], 0.0
    for first, last in shape.blocks:
        block = _center_block(centers, first, last)
        largest = max(largest, float(block.norms.max()))
        blocks.append(context.broadcast(block))
    sent += blocks
    found = vectors.withColumn("nearest", nearest_center(blocks, largest)("indices", "values"))
    return found.select(*vectors.columns, "nearest.cid", "nearest.distance2")


def lloyd_step(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """Centres after one round: ``(cid, size, indices, values, moved)``.

    A centre is the mean of its vectors, zero vectors counted; one without
    vectors stays.  ``moved`` is the squared distance to the old centre.  Each
    vector adds a constant entry, whose sum is the size of its centre.
    """
    return _step(vectors, centers, _shape(centers), [])


def _step(vectors: DataFrame, centers: DataFrame, shape: _Shape, sent: list[Broadcast]) -> DataFrame:
    points = _assign(vectors, centers, shape, sent).select(*_entries("cid", F.array(F.lit(_UNIT)), F.array(F.lit(1.0))))
    sums = points.select("cid", "idx", F.col("value").alias("sum"), F.lit(0.0).alias("old"))
    olds = centers.select(*_entries("cid", F.array(F.lit(_UNIT)), F.array(F.lit(0.0))))
    olds = olds.select("cid", "idx", F.lit(0.0).alias("sum"), F.col("value").alias("old"))
    entries = (
        sums.unionByName(olds).groupBy("cid", "idx").agg(F.sum("sum").alias("sum"), F.sum("old").alias("old"))
    )
    entry = F.when(F.col("idx") != _UNIT, F.struct("idx", "sum", "old"))
    size = F.sum(F.when(F.col("idx") == _UNIT, F.col("sum")))
    grouped = entries.groupBy("cid").agg(
        size.cast("bigint").alias("size"), F.sort_array(F.collect_list(entry)).alias("entries")
    )
    moves = F.expr(
        """filter(
             transform(entries, e -> struct(
               e.idx AS idx, if(size > 0, e.sum / size, e.old) AS value, e.old AS old)),
             e -> e.value != 0 OR e.old != 0)"""
    )
    moved = F.expr("aggregate(moves, 0D, (total, e) -> total + (e.value - e.old) * (e.value - e.old))")
    return grouped.select("cid", "size", moves.alias("moves")).select(
        "cid",
        "size",
        F.col("moves.idx").alias("indices"),
        F.col("moves.value").alias("values"),
        moved.alias("moved"),
    )


# Number of clusters, move at which rounds end, most rounds.
CLUSTERS = 30
TOLERANCE = 0.1
MAX_ROUNDS = 10


def fit(
    vectors: DataFrame,
    k: int = CLUSTERS,
    tol: float = TOLERANCE,
    max_iter: int = MAX_ROUNDS,
    centers: DataFrame | None = None,
    seed: str = "",
) -> KMeansFit:
    """Rounds of ``lloyd_step`` until the centres' summed squared move is at most ``tol``.

    Starts from ``centers`` or from ``k`` sampled vectors.
    """
    vectors, counted = cut_lineage_counted(vectors, "vectors")
    start = sample_centers(vectors, k, seed) if centers is None else centers
    current = cut_lineage(start.select("cid", "indices", "values"), "centers")
    shape, iterations, delta = _shape(current), 0, 1.0
    while shape.blocks and delta > tol and iterations < max_iter:
        sent: list[Broadcast] = []
        before, current = current, cut_lineage(_step(vectors, current, shape, sent), "centers")
        # The round is written; what it was made from is not read again.
        free(before)
        for block in sent:
            block.destroy()
        shape = _shape(current)
        iterations, delta = iterations + 1, shape.moved
    free(vectors)
    columns = [c for c in ("cid", "size", "indices", "values") if c in current.columns]
    return KMeansFit(current.select(*columns), iterations, delta, users=counted["rows"])

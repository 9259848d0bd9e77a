"""Exact top-k by inner product over a pivot-distance index.

Every vector belongs to its nearest pivot. The index holds the vectors sorted by
pivot and distance to it, cut into annuli of bounded size; of an annulus its
pivot, its least and largest distance and its longest vector are known. With
``d(q, p)`` the distance of a query to the pivot, no vector of the annulus is
nearer to the query than the gap between ``d(q, p)`` and the annulus, so that by
the triangle inequality its score is at most ``(|q|^2 + longest^2 - gap^2) / 2``.

Queries travel in blocks. A block's annuli are sorted by that bound and gone
through in rings of growing size, each a Spark job; a search ends where no bound
reaches the scores already found. An annulus whose bound equals the last score
is read, since it may hold a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlytics.llm import vectors
from postlytics.llm.vectors import Found, Shape
from postlytics.sources.staging import cut_lineage, free

#: Pivots, and vectors that they are fitted on at most.
PIVOTS = 64
SAMPLE = 20_000
#: Annuli of the first ring, and by how much the next ones grow.
RING, GROWTH = 8, 4
#: Annuli that one task goes through for a block of queries.
RUN = 64
#: Parts in which the annuli of one pivot meet the queries.
SALTS = 8
#: Relative room for rounding in bounds.
SLACK = 1e-9


def fit_pivots(x: np.ndarray, k: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Pivots of a sample by k-means from evenly spaced vectors; one zero pivot if there is none."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    x = x[np.lexsort(x.T[::-1])]
    pivots = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = distances(x, pivots).argmin(axis=1)
        size = np.bincount(own, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, x)
        pivots = sums[size > 0] / size[size > 0, None]
    return np.unique(pivots, axis=0)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    out = np.empty((len(x), len(pivots)))
    for at, pivot in enumerate(pivots):
        out[:, at] = np.sqrt(((x - pivot) ** 2).sum(axis=1))
    return out


def _sample(rows: DataFrame, kind: Shape) -> np.ndarray:
    """About ``SAMPLE`` vectors, all if there are no more, chosen by a hash."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    part = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = rows.filter(part).select("x").toArrow()["x"].combine_chunks()
    return vectors.matrix(found, kind)


def _keyed(rows: DataFrame, kind: Shape, pivots: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, x) with ``pivot``, ``distance`` and ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("x"), kind)
            far = distances(x, pivots)
            own = far.argmin(axis=1)
            made = [own.astype(np.int32), far[np.arange(len(x)), own], np.sqrt((x * x).sum(axis=1))]
            arrays = [batch.column("vec_id"), batch.column("x"), *(pa.array(c) for c in made)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "x", "pivot", "distance", "length"])

    return rows.mapInArrow(run, "vec_id long, x binary, pivot int, distance double, length double")


def _blocks(keyed: DataFrame, kind: Shape, label: str, cut_at_pivots: bool) -> DataFrame:
    """Blocks of vectors in the order of pivot and distance, written."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pivot", "distance", F.xxhash64("vec_id")]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keep = {"vec_id": "long", "pivot": "int", "distance": "double", "length": "double"}
    return cut_lineage(vectors.packed_blocks(ranged, kind, keep, "pivot" if cut_at_pivots else None), label)


def _query_summary(blocks: DataFrame, kind: Shape, pivots: np.ndarray) -> DataFrame:
    """(q, pivot, near, far, longest) for each block of queries and each pivot: its queries' distances to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = vectors.matrix(raw, kind)
                far = distances(x, pivots)
                n, longest = len(pivots), float(np.sqrt((x * x).sum(axis=1)).max())
                made = [np.full(n, number), np.arange(n, dtype=np.int32), far.min(axis=0), far.max(axis=0), np.full(n, longest)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["q", "pivot", "near", "far", "longest"])

    return blocks.select("block", "x").mapInArrow(run, "q long, pivot int, near double, far double, longest double")


def bound(query: np.ndarray, to_pivot: np.ndarray, low: float, high: float, longest: float) -> np.ndarray:
    """The most that a vector of an annulus can score, for queries of given lengths and distances to its pivot."""
    room = SLACK * (query + longest + 1) ** 2
    gap = np.maximum(0.0, np.maximum(to_pivot - high, low - to_pivot))
    return np.minimum(query * longest, (query**2 + longest**2 - gap**2) / 2) + room


def _pairs(queries: DataFrame, annuli: DataFrame, kind: Shape, pivots: np.ndarray) -> DataFrame:
    """(q, block, bound, rank): the annuli of each block of queries, from the highest bound down."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = _query_summary(queries, kind, pivots).select("*", salts)
    told = annuli.select("block", "pivot", "low", "high", F.col("length").alias("norm"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    met = asked.join(told, ["pivot", "salt"])
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("far"), F.col("near") - F.col("high"))
    room = SLACK * (F.col("longest") + F.col("norm") + 1) * (F.col("longest") + F.col("norm") + 1)
    most = F.least(F.col("longest") * F.col("norm"), (F.col("longest") * F.col("longest") + F.col("norm") * F.col("norm") - gap * gap) / 2) + room
    met = met.select("q", "block", most.alias("bound"), "near")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "near", "block"))
    return met.select("q", "block", "bound", (rank - 1).alias("rank"))


def _visit(kind: Shape, pivots: np.ndarray, k: int):
    """Function of a sorted partition: a block of queries, then its annuli from the highest bound down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            raw, lists = batch.column("x").to_pylist(), batch.column("vec_id")
            for at in range(batch.num_rows):
                if batch.column("rank")[at].as_py() < 0:
                    if asked is not None:
                        yield from told(asked)
                    x = vectors.matrix(raw[at], kind)
                    least = np.full(len(x), np.iinfo(np.int64).min)
                    for row in batch.column("least")[at].as_py() or ():
                        least[row["at"]] = row["score"]
                    far, length = distances(x, pivots), np.sqrt((x * x).sum(axis=1))
                    asked = [batch.column("q")[at].as_py(), x, vectors.ids(lists[at].values), far, length, least, vectors.nothing_found()]
                    continue
                _, x, own, far, length, least, found = asked
                low, high, longest = (batch.column(c)[at].as_py() for c in ("low", "high", "length"))
                rows = np.flatnonzero(bound(length, far[:, batch.column("pivot")[at].as_py()], low, high, longest) >= least)
                if not len(rows):
                    continue
                id, none = vectors.ids(lists[at].values)
                score = vectors.scores(x[rows], vectors.matrix(raw[at], kind), kind)
                other = (own[0][rows, None] != id) | (own[1][rows, None] != none)
                new = vectors.first_of(score, other & (score >= least[rows, None]), k, id, none)
                asked[6] = found.joined(new._replace(row=rows[new.row])).best(k)
                asked[5] = np.maximum(least, asked[6].least(len(x), k))
        if asked is not None:
            yield from told(asked)

    def told(asked: list) -> Iterator[pa.RecordBatch]:
        found: Found = asked[6]
        arrays = [np.full(len(found.row), asked[0]), found.row.astype(np.int32), found.id, found.score]
        arrays = [pa.array(c, mask=found.none if i == 2 else None) for i, c in enumerate(arrays)]
        yield pa.RecordBatch.from_arrays(arrays, ["q", "at", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, table: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``table`` for each row of ``queries`` (vec_id, embedding).

    Each component x counts as ``floor(scale * x)``; the score is the inner
    product, exact; ties go to the smaller vec_id, NULL last. Rows with the
    query's own vec_id are not among its results. Vectors that are NULL or hold
    NULL or non-finite components take no part; shorter ones are continued by
    zeros, and an empty one is zero. Rows of ``table`` that repeat are each a
    result, queries that repeat are one, and a vec_id with several vectors has a
    list for each. Fewer than ``k`` rows give fewer results, an empty table none;
    further columns are not read. A score beyond 64 bits is an error.
    """
    spark = table.sparkSession
    asked, table = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(vectors.is_finite(F.col("embedding"))) for df in (queries, table))
    kind = vectors.shape(table.select("embedding").unionByName(asked.select("embedding")), scale)
    keep = {"vec_id": "long"}
    rows = vectors.quantized(table, kind, scale, keep)
    pivots = fit_pivots(_sample(rows, kind))
    annuli = _blocks(_keyed(rows, kind, pivots), kind, "annuli", True)
    annuli = annuli.select(
        "block", "vec_id", "x", F.col("pivot")[0].alias("pivot"), F.array_min("distance").alias("low"), F.array_max("distance").alias("high"), F.array_max("length").alias("length")
    )
    once = vectors.quantized(asked, kind, scale, keep).distinct()
    blocks = _blocks(_keyed(once, kind, pivots), kind, "queries", False)
    pairs = cut_lineage(_pairs(blocks, annuli, kind, pivots), "pairs")
    last = pairs.agg(F.max("rank")).first()[0]
    best = _search(spark, blocks, annuli, pairs, last, kind, pivots, k)
    named = blocks.select(F.col("block").alias("q"), F.posexplode("vec_id").alias("at", "query_id"))
    ranked = best.join(named, ["q", "at"])
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(spark, blocks: DataFrame, annuli: DataFrame, pairs: DataFrame, last: int | None, kind: Shape, pivots: np.ndarray, k: int) -> DataFrame:
    """(q, at, rank, vec_id, score) of all queries, ring by ring."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("q", "at").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best, first, size = None, 0, RING
    while last is not None and first <= last:
        ring = pairs.filter(F.col("rank").between(first, first + size - 1))
        least = blocks.select(F.col("block").alias("q"), F.lit(None).cast("array<struct<at: int, score: bigint>>").alias("least"))
        if best is not None:
            kth = best.filter(F.col("rank") == k).groupBy("q").agg(F.collect_list(F.struct("at", "score")).alias("least"), F.min("score").alias("lowest"))
            # A block whose queries all have k results needs only the annuli that reach the lowest of the last ones.
            full = blocks.select(F.col("block").alias("q"), "n").join(kth, "q", "left")
            least = full.select("q", "least", F.when(F.size("least") == F.col("n"), F.col("lowest")).alias("lowest"))
            ring = ring.join(least.select("q", "lowest"), "q").filter(F.col("lowest").isNull() | (F.col("bound") >= F.col("lowest"))).drop("lowest")
            least = least.drop("lowest")
        ring = cut_lineage(ring.withColumn("run", F.floor((F.col("rank") - first) / RUN)), "ring")
        if ring.isEmpty():
            # Later rings have lower bounds.
            break
        visits = ring.join(annuli, "block").select("q", "run", "rank", "vec_id", "x", "pivot", "low", "high", "length", F.lit(None).cast("array<struct<at: int, score: bigint>>").alias("least"))
        heads = ring.select("q", "run").distinct().join(blocks.select(F.col("block").alias("q"), "vec_id", "x"), "q").join(least, "q")
        missing = [F.lit(None).cast(t).alias(c) for c, t in (("pivot", "int"), ("low", "double"), ("high", "double"), ("length", "double"))]
        heads = heads.select("q", "run", F.lit(-1).alias("rank"), "vec_id", "x", *missing, "least")
        dealt = visits.unionByName(heads).repartition(parts, "q", "run").sortWithinPartitions("q", "run", "rank")
        found = dealt.mapInArrow(_visit(kind, pivots, k), "q long, at int, vec_id long, score long")
        both = found if best is None else found.unionByName(best.drop("rank"))
        before, best = best, cut_lineage(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        free(ring)
        if before is not None:
            free(before)
        first, size = first + size, size * GROWTH
    if best is None:
        return spark.createDataFrame([], "q long, at int, rank int, vec_id long, score long")
    return best

"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.sources.staging import cut_lineage, shuffles_for

#: Edges of a round that one task writes, but for the cores to have a task each.
EDGES_PER_TASK = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the smallest node names a component.

    Large stars hang each node's larger neighbours under the smallest node it
    knows, small stars its smaller ones; both keep components and end in stars.
    Only minima are aggregated, so a node with very many edges costs no more
    than its edges, and each round's edges are written to the shared folder, a
    round having no more than twice those before it, in as few files as they need.
    Rounds shuffle into as few tasks as their edges need, as there are many of them.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = cut_lineage(now, "edges")
    state = _state(now)
    while state[0]:
        with shuffles_for(spark, 2 * state[0], EDGES_PER_TASK):
            now = _round(now, max(spark.sparkContext.defaultParallelism, 2 * state[0] // EDGES_PER_TASK + 1))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _round(now: DataFrame, tasks: int) -> DataFrame:
    """The edges after a large and a small star, staged by at most ``tasks`` tasks."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return cut_lineage(small.unionByName(lowest.withColumnRenamed("m", "b")).distinct().coalesce(tasks), "edges")


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges; one row."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)

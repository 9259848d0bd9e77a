"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlytics.llm.words import count_words, fresh_names, numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix"


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    ``sizes`` holds one row per source with its ``source_size``. Sources in order
    of code points, NULL last, weigh ``weights`` in turn. Filling all targets in
    step with their weights, each until its ceiling of ``max_copies`` times its
    size, gives what resharing the excess over and over comes to.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        sizes.withColumn("_weight", F.get(cycle, F.pmod(turn, F.lit(len(weights)))))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("_full", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_caps_before", F.sum("_cap").over(filled) - F.col("_cap"))
        .withColumn("_weights_left", F.col("_weights") - F.sum("_weight").over(filled) + F.col("_weight"))
        .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / F.col("_weights_left"))
    )
    # The level at the first source that it does not fill; if it fills all, they are all at their caps.
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(everything)
    return ranked.withColumn("_at", level["_level"]).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_weight"), F.col("_cap"))).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: str = SEED,
    size: str | None = None,
) -> DataFrame:
    """``docs`` with columns size, source_size, target and copies.

    Needs doc_id and source, and text unless ``size`` names a column of sizes.
    Within a source documents go by size; a document whose running sum of
    expected copies, begun at the source's offset, crosses k integers is taken k
    times. So each source's words are off by about one document's size at most.

    NULL texts and texts without words have size 0; NULL sources are one source;
    repeated rows are taken each by itself; an empty table gives an empty result.
    Columns of ``docs`` called as the new ones give way to them, and other
    columns stay as they are.
    """
    measured = docs.withColumn("size", F.col(size).cast("long") if size else count_words(F.col("text")))
    measured = measured.drop("source_size", "target", "copies")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    at, first, of, each, offset = fresh_names(measured, "_at", "_first", "_source", "_each", "_offset")
    ranked = numbered(measured, order, "mix", at)
    sums = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(at).alias(first))
    targets = source_targets(sums.select("source", "source_size"), weights, share, max_copies)
    starts = sums.select(F.col("source").alias("_same"), first)
    plan = targets.join(starts, F.col("source").eqNullSafe(F.col("_same"))).drop("_same").withColumnRenamed("source", of)
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col(of)), "left")
    share_of_each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10)
    place = F.col(at) - F.col(first)
    crossed = F.floor((place + 1) * F.col(each) + F.col(offset)) - F.floor(place * F.col(each) + F.col(offset))
    return (
        joined.withColumn(each, share_of_each)
        .withColumn(offset, drawn.cast("double") / F.lit(float(1 << 32)))
        .withColumn("copies", F.least(crossed, F.lit(max_copies)).cast("long"))
        .drop(at, first, of, each, offset)
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken, with ``copy`` from 1 up in place of ``copies``; a column called so before gives way."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")

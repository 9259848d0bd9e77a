"""Words of whole texts and ordered positions of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlytics.sources.staging import cut_lineage

#: A word is a run of anything but space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Of a batch, so many texts at a time are Python objects.
RUN = 256
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_2 = np.uint64(0xD6E8FEB86659FD93)


def word_bytes(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` knows exactly the blanks of ``WORD``."""
    return text.encode("utf-8", "replace").split() if text else []


def count_words(text) -> F.Column:
    """Number of words, 0 for NULL, by JVM functions alone."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * ODD_2
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until no column of ``df`` has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list, label: str, at: str = "at") -> DataFrame:
    """``df`` with its position in ``order`` from 0 up as ``at``, without one task for all rows; other columns stay.

    Rows are dealt by range, written with their place in their part, and the
    parts' sizes, one row each, are summed up before them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid, part, size, before = fresh_names(df, "_mid", "_part", "_n", "_before")
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(mid, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(mid, 33))
    )
    staged = cut_lineage(placed, label)
    sizes = staged.groupBy(part).agg(F.count("*").alias(size))
    summed = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    sizes = sizes.select(part, summed.alias(before))
    place = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each of the shuffle's partitions.
    return staged.join(F.broadcast(sizes), part).withColumn(at, F.col(before) + place).drop(part, mid, before)


def each_text(texts: pa.Array, function: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``function`` of each text; only a short run of the texts at a time is held as Python objects."""
    runs = (texts[at : at + RUN] for at in range(0, len(texts), RUN))
    made = [pa.array([function(x.as_py()) for x in run], kind) for run in runs]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def per_text(
    docs: DataFrame,
    columns: dict[str, pa.DataType],
    function: Callable[[str | None], tuple],
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keys`` of each row of ``docs``, 64-bit numbers, with what ``function`` makes of its ``text`` in ``columns``.

    Keys cross as Arrow columns, so that large ones beside NULLs stay exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(x.as_py()) for x in batch.column("text")]
            made = zip(*found, strict=True) if found else ((),) * len(columns)
            arrays = [pa.array(list(x), t) for x, t in zip(made, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *arrays], [*keys, *columns])

    names = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}
    schema = ", ".join([*(f"{k} long" for k in keys), *(f"{c} {names[t]}" for c, t in columns.items())])
    return docs.select(*(F.col(k).cast("long").alias(k) for k in keys), "text").mapInArrow(run, schema)

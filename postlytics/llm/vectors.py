"""Whole-number vectors, packed in blocks of bounded size, and the best of many scores.

Components become ``floor(scale * x)``, which a double always holds exactly. A
block is one row: the packed vectors of many rows beside their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of packed vectors in one block, and rows at most.
BLOCK_BYTES = 1 << 17
BLOCK_ROWS = 1024
#: Products and sums below this are exact in doubles.
EXACT = 2.0**53


class Shape(NamedTuple):
    """Components of the longest vector, numpy type that holds them all, and whether doubles hold every score exactly."""

    width: int
    dtype: str
    exact: bool

    @property
    def rows(self) -> int:
        """Vectors in a block."""
        return int(max(16, min(BLOCK_ROWS, BLOCK_BYTES // (self.width * np.dtype(self.dtype).itemsize))))


def is_finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; an empty vector is."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def shape(vectors: DataFrame, scale: float) -> Shape:
    """Of ``vectors`` (embedding), all finite; one row comes to the driver."""
    magnitude = F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double"))))
    width, most = vectors.agg(F.max(F.size("embedding")), F.max(magnitude)).first()
    width, most = max(width or 0, 1), float(np.ceil((most or 0.0) * scale))
    dtype = next((t for t in ("i1", "i2", "i4") if most < np.iinfo(t).max), "f8")
    return Shape(width, dtype, most * most * width < EXACT)


def quantized(vectors: DataFrame, kind: Shape, scale: float, keep: dict[str, str]) -> DataFrame:
    """``vectors`` (embedding and the columns of ``keep``, name to SQL type) with ``x``, the packed whole numbers.

    Vectors shorter than the longest are continued by zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.asarray(column.value_lengths(), dtype=np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.zeros((len(sizes), kind.width), dtype=kind.dtype)
            out[at, place] = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), binaries(out)], [*keep, "x"])

    schema = ", ".join([*(f"{c} {t}" for c, t in keep.items()), "x binary"])
    return vectors.select(*keep, "embedding").mapInArrow(run, schema)


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def matrix(column: pa.Array | bytes, kind: Shape) -> np.ndarray:
    """Vectors, one a row, as doubles, from a column of them or from a block."""
    raw = column if isinstance(column, bytes) else b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=kind.dtype).reshape(-1, kind.width).astype(np.float64)


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids, and which of them are NULL."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.is_null())


def scores(a: np.ndarray, b: np.ndarray, kind: Shape) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b`` as 64-bit whole numbers; an error if one passes 64 bits."""
    if kind.exact:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(e) for e in row] for row in x], dtype=object).reshape(len(x), -1) for x in (a, b)]
    return whole[0].dot(whole[1].T).astype(np.int64)


def pairwise(a: np.ndarray, b: np.ndarray, kind: Shape) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` at the same place."""
    if kind.exact:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], dtype=object).astype(np.int64)


def packed_blocks(rows: DataFrame, kind: Shape, keep: dict[str, str], run: str | None = None) -> DataFrame:
    """``rows`` (x and the columns of ``keep``) in their order, gathered in blocks: (block, n, a list for each of ``keep``, x).

    A block ends with its task, when it is full, and where the value of ``run`` changes. Its number is unique.
    """
    names = [*keep, "x"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            found = list(cut(rest, False))
            for part in found[:-1]:
                yield block(part, number)
                number += 1
            rest = found[-1] if found else None
        for part in cut(rest, True) if rest is not None else ():
            yield block(part, number)
            number += 1

    def cut(table: pa.Table, last: bool) -> Iterator[pa.Table]:
        edges = [0, len(table)]
        if run and len(table):
            value = table[run].to_numpy()
            edges = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(table)]
        for low, high in zip(edges, edges[1:]):
            for at in range(low, high, kind.rows):
                yield table.slice(at, min(kind.rows, high - at))

    def block(part: pa.Table, number: int) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[c].combine_chunks()) for c in keep]
        x = b"".join(part["x"].to_pylist())
        arrays = [pa.array([number]), pa.array([len(part)], pa.int32()), *lists, pa.array([x], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["block", "n", *names])

    schema = ", ".join(["block long", "n int", *(f"{c} array<{t}>" for c, t in keep.items()), "x binary"])
    return rows.select(*names).mapInArrow(pack, schema)


class Found(NamedTuple):
    """Entries of a score table: row, score, id and whether the id is NULL."""

    row: np.ndarray
    score: np.ndarray
    id: np.ndarray
    none: np.ndarray

    def best(self, k: int) -> Found:
        """The first ``k`` of each row: higher scores first, ties by smaller id, NULL last; sorted so."""
        order = np.lexsort((self.id, self.none, -self.score, self.row))
        row = self.row[order]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=int)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        return Found(*(c[order[place < k]] for c in self))

    def joined(self, other: Found) -> Found:
        return Found(*(np.concatenate(pair) for pair in zip(self, other, strict=True)))

    def least(self, n: int, k: int) -> np.ndarray:
        """The ``k``-th score of each of ``n`` rows, the smallest 64-bit number where there are fewer; for ``best(k)``."""
        out = np.full(n, np.iinfo(np.int64).min)
        count = np.bincount(self.row, minlength=n)
        last = np.cumsum(count) - 1
        out[count >= k] = self.score[last[count >= k]]
        return out


def nothing_found() -> Found:
    return Found(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool)))


def first_of(table: np.ndarray, allowed: np.ndarray, k: int, id: np.ndarray, none: np.ndarray) -> Found:
    """The first ``k`` allowed entries of each row of a score table, among ties by id."""
    low = np.iinfo(np.int64).min
    if table.shape[1] > k:
        # Only what reaches the k-th score of its row has to be sorted.
        masked = np.where(allowed, table, low)
        allowed = allowed & (table >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    row, at = np.nonzero(allowed)
    return Found(row, table[row, at], id[at], none[at]).best(k)

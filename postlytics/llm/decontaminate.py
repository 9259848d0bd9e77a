"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.llm.words import ODD, each_text

#: Eight bytes are one 64-bit number, so that q-grams are compared as they are.
Q = 8
#: Edits allowed, as a share of an item's length.
EDITS = 0.1
#: Items are searched in blocks of so many bytes, so that an index has a size bound.
BLOCK_BYTES = 4 << 20
_PIECE = 1 << 20
_SIEVE_BITS = 21
_PUNCTUATION = bytes.maketrans(string.punctuation.encode() + b"\t\n\r\x0b\x0c", b" " * (len(string.punctuation) + 5))


def normalized(text: str | None) -> bytes:
    """Lower case, runs of ASCII blanks and punctuation as one space, one at either end."""
    words = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def grams(text: bytes) -> np.ndarray:
    if len(text) < Q:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text, dtype=np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, Q)).view("<u8").ravel()


def banded_distance(item: bytes, text: bytes, budget: int) -> tuple[int, int]:
    """Fewest edits between ``item`` and any substring of ``text``, and where that ends; over ``budget`` if there is none.

    The alignment may begin at any of the first characters of ``text``, which is
    no longer than item and band, and stays in the band of these diagonals.
    """
    pattern, body = np.frombuffer(item, dtype=np.uint8), np.frombuffer(text, dtype=np.uint8)
    width = len(body) - len(pattern) + 1 + 2 * budget
    if width <= 0:
        return budget + 1, 0
    over = budget + 1
    steps = np.arange(width)
    # Cell d of row i stands for the first i characters of the item against the text up to i + d - budget.
    padded = np.concatenate((np.zeros(budget, dtype=np.uint8), body, np.zeros(width + budget, dtype=np.uint8)))
    inside = np.concatenate((np.zeros(budget, dtype=bool), np.ones(len(body), dtype=bool), np.zeros(width + budget, dtype=bool)))
    row = np.where(steps >= budget, 0, over)
    for i in range(len(pattern)):
        same = (padded[i : i + width] == pattern[i]) & inside[i : i + width]
        cross = row + ~same
        cross[~inside[i : i + width]] = over
        cross[:-1] = np.minimum(cross[:-1], row[1:] + 1)
        row = cross
        row = np.minimum(np.minimum.accumulate(row - steps) + steps, over)
        if row.min() == over:
            return over, 0
    # Ends beyond the text are none.
    ends = len(pattern) + steps - budget
    row = np.where((ends >= 0) & (ends <= len(body)), row, over)
    best = int(row.argmin())
    return int(row[best]), int(ends[best])


class ItemIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], edits: float = EDITS) -> None:
        self.items = items
        length = np.array([len(t) for _, t in items], dtype=np.int64)
        # At most so many edits, and so few that an item with these still shares a q-gram.
        self.budget = np.maximum(0, np.minimum((length * edits).astype(np.int64), (length - Q) // Q))
        self.least = length - Q + 1 - self.budget * Q
        self.short = [i for i, (_, t) in enumerate(items) if len(t) < Q]
        parts = [grams(t) for _, t in items]
        gram = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(p) for p in parts])
        place = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, dtype=np.int64)])
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[self._slot(self.gram)] = True
        self.longest = int((length + 4 * (self.budget + 1)).max()) if len(items) else 0

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * ODD) >> np.uint64(64 - _SIEVE_BITS)

    def matches(self, text: str | None) -> dict[int, tuple[int, int]]:
        """For each item found: edits and start in the normalized text, of the best place, the first of equals."""
        body, out = normalized(text), {}
        for i in self.short:
            at = body.find(self.items[i][1]) if self.items[i][1] else -1
            if at >= 0:
                out[i] = (0, at)
        at = 0
        while len(body) - at >= Q:
            # Pieces overlap by the longest match, so that each match lies in one.
            for i, (edits, start) in self._piece(body[at : at + _PIECE + self.longest]):
                out[i] = min(out.get(i, (edits, start + at)), (edits, start + at))
            at += _PIECE
        return out

    def _piece(self, body: bytes) -> Iterator[tuple[int, tuple[int, int]]]:
        gram = grams(body)
        where = np.flatnonzero(self.sieve[self._slot(gram)])
        if not len(where):
            return
        gram = gram[where]
        slot = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        known = self.gram[slot] == gram
        where, slot = where[known], slot[known]
        if len(where) < self.least[self.least > 0].min(initial=1 << 60):
            return
        times = self.times[slot]
        at = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        owner, place, spot = self.owner[at], self.place[at], np.repeat(where, times)
        # An alignment within the budget keeps to budget + 1 diagonals. Bands of twice that, each
        # overlapping half of the next, hold it whole.
        half = self.budget[owner] + 1
        band = (spot - place + self.longest) // half
        key = np.concatenate((owner, owner)) * np.int64(1 << 40) + np.concatenate((band, band - 1))
        key, at, hits = np.unique(key, return_inverse=True, return_counts=True)
        enough = hits >= self.least[key >> 40]
        if not enough.any():
            return
        # An item's q-gram counts once in a band, however often the text has it there.
        at, place = at[enough[at]], np.concatenate((place, place))[enough[at]]
        order = np.lexsort((place, at))
        at, place = at[order], place[order]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (place[1:] != place[:-1])))
        shared = np.bincount(at[new], minlength=len(key))
        owner, band = key >> 40, key & ((1 << 40) - 1)
        enough = shared >= self.least[owner]
        for i, j in zip(owner[enough].tolist(), band[enough].tolist(), strict=True):
            item, budget = self.items[i][1], int(self.budget[i])
            low = j * (budget + 1) - self.longest
            start = max(0, low)
            region = body[start : low + 2 * (budget + 1) + len(item) + budget]
            found = region.find(item)
            if found >= 0:
                yield i, (0, start + found)
                continue
            edits, end = banded_distance(item, region, budget)
            if edits <= budget:
                yield i, (edits, max(0, start + end - len(item)))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items as blocks of bounded size, one at a time on the driver; NULL and blank items are none."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normalized(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


_MATCHES = "doc_id long, item_id long, edits long, start long"


def find_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edits, start): the items that each row of ``docs`` (doc_id, text) holds, one row for each.

    An item is held if the normalized text has a part that ``edits`` times its
    length edits or fewer turn into the normalized item; ``start`` is about where.
    Items under eight bytes are searched as they are, as whole words. NULL and blank texts and
    items match nothing; texts are read whole; repeated rows and items match each
    for themselves, empty tables not at all; further columns are not read.
    Blocks of items of bounded size are each searched in all documents.
    """
    found = docs.sparkSession.createDataFrame([], _MATCHES)
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc.as_py(), index.value.items[i][0], e, at)
                    for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                    for i, (e, at) in index.value.matches(text.as_py()).items()
                ]
                columns = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, _MATCHES))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns as they are."""
    for block in item_blocks(benchmark):
        docs = docs.filter(_holds_none(docs.sparkSession.sparkContext.broadcast(ItemIndex(block, edits)))("text"))
    return docs


def _holds_none(index: Broadcast) -> Callable[..., Column]:
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return each_text(texts, lambda t: not index.value.matches(t), pa.bool_())

    return clean

"""A Bloom filter of keys as a small table of bit words, tested by a broadcast join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: a million words of 64 bits, two longs each, so 16 MB to send and about 64 MB as a hash table.
BITS = 1 << 26


def _slots(key: Column, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")


def bloom_filter(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``(word, mask)``: the bits of all ``key`` values of ``keys``; never more than ``bits / 64`` rows."""
    word, bit = _slots(F.col(key), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return keys.select(word.alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def may_hold(rows: DataFrame, key: str, filter_: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` without those whose ``key`` is surely not in the filter; a few others may stay, NULL keys do not."""
    word, bit = _slots(F.col(key), bits)
    asked = rows.filter(F.col(key).isNotNull()).withColumns({"_word": word, "_bit": bit})
    known = F.broadcast(filter_.select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
    met = asked.join(known, "_word")
    hit = F.call_function("shiftrightunsigned", F.col("_mask"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1
    return met.filter(hit).select(*rows.columns)

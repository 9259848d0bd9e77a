"""The Bloom filter of keys."""

import pytest
from pyspark.sql import functions as F

from postlytics.functions.membership import bloom_filter, may_hold


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 26])
def test_members_stay_and_few_others(spark, bits):
    rows = spark.range(-500, 4500).select(F.col("id").alias("k"), F.lit("x").alias("_note"))
    rows = rows.unionByName(spark.createDataFrame([(None, "x")], "k long, _note string"))
    keys = spark.range(0, 200).select((F.col("id") * 7).alias("k"))
    found = bloom_filter(keys, "k", bits)
    assert found.count() <= bits // 64
    kept = may_hold(rows, "k", found, bits)
    assert kept.columns == ["k", "_note"]
    ids = [r["k"] for r in kept.collect()]
    assert set(range(0, 1400, 7)) <= set(ids) and len(ids) == len(set(ids)) and None not in ids
    if bits == 1 << 12:
        assert len(ids) < 200 + 0.1 * 5000
    if bits == 1 << 26:
        assert len(ids) == 200


def test_nothing_is_in_an_empty_filter(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert may_hold(rows, "k", bloom_filter(rows.filter("k > 99"), "k")).count() == 0

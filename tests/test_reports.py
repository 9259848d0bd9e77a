"""Reports survive their round trip, and counts come with the writing."""

import math

import pytest

from postlytics.sources.observed import observe
from postlytics.sources.reports import read_report, write_report

SCHEMA = "id bigint, name string, weight double, good boolean"
NAMES = ["", None, "plain", "a\tb", "a\nb", "a\r\nb", '"quoted"', "back\\slash", "\\N", "\\t", "\\\\", "\\", "\\\\t\\\n\\", "N", " ", "x\\\ty", "\x0b\x85 ", "😀"]


def rows():
    return [(i - 3, n, w, g) for i, n in enumerate(NAMES) for w, g in ((i / 7, True), (None, None))]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "report")
    told = write_report(spark.createDataFrame(rows(), SCHEMA), path, {"rows": "count(1)", "named": "count(name)", "sum": "sum(id)"})
    assert told == {"rows": 2 * len(NAMES), "named": 2 * len(NAMES) - 2, "sum": sum(r[0] for r in rows())}
    found = read_report(spark, path, SCHEMA)
    assert found.schema.simpleString() == "struct<id:bigint,name:string,weight:double,good:boolean>"
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows()))


def test_one_line_a_row_in_order(spark, tmp_path):
    path = tmp_path / "report"
    df = spark.createDataFrame(rows(), SCHEMA).orderBy("id", "weight")
    write_report(df, str(path))
    lines = "".join(p.read_text(encoding="utf-8", newline="") for p in sorted(path.glob("part-*"))).split("\n")[:-1]
    assert len(lines) == 2 * len(NAMES) and all(line.count("\t") == 3 for line in lines)
    assert [int(line.split("\t")[0]) for line in lines] == sorted(r[0] for r in rows())


def test_single_fields_and_extremes(spark, tmp_path):
    texts = [("",), (None,), ("\n",)]
    write_report(spark.createDataFrame(texts, "t string"), str(tmp_path / "t"))
    assert sorted(map(repr, map(tuple, read_report(spark, str(tmp_path / "t"), "t string").collect()))) == sorted(map(repr, texts))
    numbers = [(5e-324,), (1.7976931348623157e308,), (0.1 + 0.2,), (-0.0,), (math.inf,)]
    write_report(spark.createDataFrame(numbers, "x double"), str(tmp_path / "x"))
    assert sorted(read_report(spark, str(tmp_path / "x"), "x double").collect()) == sorted(numbers)


def test_nested_types_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="plain types"):
        read_report(spark, str(tmp_path), "a array<int>")


def test_counts_without_a_second_read(spark, tmp_path):
    """Each row is made once, although its number is told."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(count, "id long")
    assert write_report(df, str(tmp_path / "r")) == {"rows": 100} and made.value == 100
    watched, told = observe(spark.range(5).filter("id > 9"), {"rows": "count(1)", "total": "sum(id)"})
    assert watched.collect() == [] and told() == {"rows": 0, "total": 0}

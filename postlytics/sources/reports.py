"""Reports: rows as tab-separated lines, written and read back.

A backslash, a tab and either line end within a field are written as a
backslash and a letter (``\\\\``, ``\\t``, ``\\n``, ``\\r``), NULL as ``\\N``; so every row is one
line, an empty field is an empty string, and a report can be read in splits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType

from postlytics.sources.observed import ROWS, observe

# What stands for what within a field; backslashes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
NULL = "\\N"


def _escaped(field: Column) -> Column:
    for plain, written in ESCAPES:
        field = F.replace(field, F.lit(plain), F.lit(written))
    return F.coalesce(field, F.lit(NULL))


def _plain(field: Column) -> Column:
    def read(part: Column) -> Column:
        for plain, written in ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    # Two backslashes are one; what is between such pairs holds only the other escapes.
    parts = F.transform(F.split(field, r"\\\\", -1), read)
    return F.when(field != NULL, F.array_join(parts, "\\"))


def write_report(df: DataFrame, path: str, counts: Mapping[str, str] = ROWS) -> dict[str, int]:
    """Write one line per row; gives ``counts`` (name to SQL aggregate) of the rows, taken in the same pass.

    Sorted rows stay sorted over the files in the order of their names.
    """
    watched, told = observe(df, counts)
    fields = [_escaped(F.col(f"`{c}`").cast("string")) for c in df.columns]
    watched.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)
    return told()


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a report of plain types; ``schema`` names and types its fields."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if nested := [f.name for f in schema if not isinstance(f.dataType, AtomicType)]:
        raise ValueError(f"reports hold plain types only, not those of {nested}")
    fields = spark.read.option("lineSep", "\n").text(path).select(F.split("value", "\t", -1).alias("fields"))
    return fields.select(*[_plain(F.get("fields", F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])

"""Post readers: raw JSON lines and part-of-speech tagged lines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.text import split_words

# Parsed column -> (JSON schema that holds it, path inside that schema).  Only the
# fields a job asks for enter the parser's schema.
_USER_FIELDS = {"user_id": "id", "user_name": "name", "user_description": "description"}
_TOP_FIELDS = {"post_id": "id", "text": "text"}
# Field of the object that marks the end of a line.
_END = "end of the line"


def numbered_paths(folder: str, prefix: str, first: int, last: int) -> list[str]:
    """``folder/prefixNN`` for every NN from ``first`` to ``last``, two digits at least."""
    return [f"{folder.rstrip('/')}/{prefix}{n:02d}" for n in range(first, last + 1)]


def read_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Lines of all files as one scan, in a column ``value``; no paths, no rows."""
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], "value string")
    return spark.read.text(paths)


def union_posts(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of several post tables, matched by column name; of none, no posts."""
    frames = list(frames)
    if not frames:
        return SparkSession.active().createDataFrame([], "post_id long, user_id long, text string")
    return reduce(DataFrame.unionByName, frames)


def _with_post(lines: DataFrame, line: Column, fields: Iterable[str]) -> DataFrame:
    """``lines`` with ``post``: the line as one JSON object, or NULL where it is anything else.

    The line is parsed as the first of two elements of an array, the second of
    which marks the end. Junk behind the object breaks the array, a second object
    makes it longer, and a line that closes the array itself cuts off the mark.
    The parsed value is projected first and used by the next projection, so that
    each line is parsed once.
    """
    top = [f"{_TOP_FIELDS[f]}: string" for f in fields if f in _TOP_FIELDS]
    user = [f"{_USER_FIELDS[f]}: string" for f in fields if f in _USER_FIELDS]
    if user:
        top.append(f"user: struct<{', '.join(user)}>")
    top.append(f"`{_END}`: string")
    parsed = F.from_json(
        F.concat(F.lit("["), line, F.lit(f',{{"{_END}":1}}]')), f"array<struct<{', '.join(top)}>>", {"allowSingleQuotes": "false"}
    )
    found = lines.withColumn("parsed", parsed)
    first, second = F.get("parsed", F.lit(0)), F.get("parsed", F.lit(1))
    good = (F.size("parsed") == 2) & (second[_END] == "1") & first[_END].isNull()
    return found.withColumn("post", F.when(good, first)).drop("parsed")


def _field(post: Column, name: str) -> Column:
    value = post["user"][_USER_FIELDS[name]] if name in _USER_FIELDS else post[_TOP_FIELDS[name]]
    return value.try_cast("bigint") if name.endswith("_id") else value


def parse_raw_posts(lines: DataFrame, fields=("post_id", "user_id", "text")) -> DataFrame:
    """Posts from JSON lines; a field a line does not give is NULL, never a magic value."""
    parsed = _with_post(lines.select("value"), F.col("value"), fields)
    return parsed.select(*[_field(F.col("post"), f).alias(f) for f in fields])


def read_raw_posts(spark: SparkSession, paths: Iterable[str], fields=("post_id", "user_id", "text")) -> DataFrame:
    return parse_raw_posts(read_lines(spark, paths), fields)


def parse_tagged_posts(lines: DataFrame, fields=("user_id", "user_name", "user_description")) -> DataFrame:
    """Posts from lines of tab-separated tokens, tags, an unused field and the raw JSON.

    ``tags`` is NULL where the line has no tag field, and the JSON fields are
    NULL where the JSON is missing or broken.
    """
    parts = lines.select(F.split("value", "\t").alias("part"))
    words = [
        split_words(F.get("part", F.lit(0))).alias("tokens"),
        split_words(F.get("part", F.lit(1))).alias("tags"),
    ]
    if not fields:
        return parts.select(*words)
    parsed = _with_post(parts, F.get("part", F.lit(3)), fields).select(*words, "post")
    return parsed.select("tokens", "tags", *[_field(F.col("post"), f).alias(f) for f in fields])


def read_tagged_posts(
    spark: SparkSession, paths: Iterable[str], fields=("user_id", "user_name", "user_description")
) -> DataFrame:
    return parse_tagged_posts(read_lines(spark, paths), fields)

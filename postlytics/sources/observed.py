"""Counts of a result, taken while it is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: What is counted if nothing else is asked for.
ROWS = {"rows": "count(1)"}


def observe(df: DataFrame, counts: Mapping[str, str] = ROWS) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df``, and a function that tells ``counts`` (name to SQL aggregate) once ``df`` was written or collected.

    They are taken from the rows as they pass, so nothing is read twice; sums
    over no rows are 0. They are for reports: Spark may count a task again that
    it had to run again.
    """
    seen = Observation()
    watched = df.observe(seen, *[F.expr(sql).alias(name) for name, sql in counts.items()])
    return watched, lambda: {name: seen.get[name] or 0 for name in counts}

"""Counting and aggregating rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.countDistinct}


def group_rows(frame: DataFrame, keys: Mapping[str, Column], aggregates: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """One row for each combination of keys; without keys one row, even of nothing.

    NULL is a key like any other. Sums and counts are combined before the shuffle.
    """
    made = []
    for name, (fn, column) in aggregates.items():
        if fn not in FUNCTIONS:
            raise ValueError(f"Unknown aggregate {fn!r}; there are {', '.join(FUNCTIONS)}")
        if column is None and fn != "count":
            raise ValueError(f"{fn} needs an expression")
        made.append(FUNCTIONS[fn](F.lit(1) if column is None else column).alias(name))
    return frame.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*made)


def count_rows(frame: DataFrame, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """The number of rows for each combination of keys, as ``count``."""
    return group_rows(frame, keys or {}, {"count": ("count", None)})

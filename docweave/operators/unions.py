"""Unions of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import PATH


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; columns go by name, and one that a side lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _rows_of(frame: DataFrame) -> list[str]:
    """The aliases whose documents have a path."""
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StructType) and PATH in f.dataType.names]


def union_by_path(*frames: DataFrame) -> DataFrame:
    """Rows of the same documents once: their identity is the paths of all aliases.

    Rows in which no document has a path are all kept.
    """
    out = union_all(*frames)
    paths = [F.col(f"`{a}`").getField(PATH) for a in _rows_of(out)]
    if not paths:
        return out
    names = [f"__path_{i}" for i in range(len(paths))]
    keyed = out.withColumns(dict(zip(names, paths, strict=True)))
    known = reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in names))
    return keyed.where(known).dropDuplicates(names).unionByName(keyed.where(~known)).drop(*names)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of equal content once; paths are not content, but aliases are."""
    out = union_all(*frames)
    aliases = _rows_of(out)
    names = [f"__content_{i}" for i in range(len(aliases))]
    content = {n: F.col(f"`{a}`").dropFields(PATH) if len(out.schema[a].dataType.names) > 1 else F.col(f"`{a}`").isNotNull() for n, a in zip(names, aliases, strict=True)}
    others = [c for c in out.columns if c not in aliases]
    return out.withColumns(content).dropDuplicates([*names, *others]).drop(*names)

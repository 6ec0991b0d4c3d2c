"""Names of collections and the tables behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Collection, Field

#: Column with a document's path; identifiers, parents and collections follow from it.
PATH = "__path"


class Catalog:
    """Collections by path. A table may hold one collection or, with document
    paths, any number of sub-collections of one name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        #: The column that tells a table's documents apart.
        self.ids: dict[str, str | None] = {}

    def register(self, path: str, table: DataFrame, id_col: str | None = None, path_col: str | None = None) -> DataFrame:
        """Make ``table`` known as collection ``path``.

        ``path_col`` holds each document's whole path; else ``id_col`` is appended
        to the collection's path. With neither, documents have no metadata.
        """
        if path_col is not None:
            at = F.col(path_col)
        elif id_col is not None:
            at = F.concat_ws("/", F.lit(path), F.col(id_col).cast("string"))
            at = F.when(F.col(id_col).isNotNull(), at)
        else:
            at = F.lit(None)
        out = table.withColumn(PATH, at.cast("string"))
        if path_col not in (None, PATH):
            out = out.drop(path_col)
        self.tables[path.strip("/")] = out
        self.ids[path.strip("/")] = PATH if path_col is not None else id_col
        return out

    def read(self, path: str, location: str, format: str = "parquet", id_col: str | None = None, path_col: str | None = None, **options: str) -> DataFrame:
        """Register files that Spark reads."""
        return self.register(path, self.spark.read.format(format).options(**options).load(location), id_col, path_col)

    def identity(self, collection: Collection) -> tuple[str | None, set[str]]:
        """The column that tells a collection's documents apart, if there is one, and the
        fields of which each document has its own value."""
        name = None if collection.group else "/".join(map(str, collection.path))
        own = self.ids.get(name) if name is not None else None
        return own, {own, "#id", "#path"} if own not in (None, PATH) else {"#path"} if own else set()

    def scan(self, collection: Collection) -> tuple[DataFrame, list[tuple[int, Field]]]:
        """The documents of a collection, and the path segments that must equal fields
        of other sources (segments count from the left, from 0)."""
        *_, leaf = collection.path
        if isinstance(leaf, Field):
            raise ValueError("The last segment of a collection's path can't be a field")
        if collection.group:
            found = [t for p, t in sorted(self.tables.items()) if p.split("/")[-1] == leaf]
            if not found:
                raise KeyError(f"No collection is named {leaf!r}")
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), []
        name = "/".join(map(str, collection.path))
        if name in self.tables:
            return self.tables[name], []
        if len(collection.path) == 1:
            raise KeyError(f"Unknown collection {name!r}")
        # documents of nested collections are found by their paths
        size = len(collection.path)
        found = [t for p, t in sorted(self.tables.items()) if p.split("/")[-1] == leaf and (p.count("/") == 0 or self._fits(p, collection))]
        if not found:
            raise KeyError(f"Unknown collection {name!r}")
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        parts = F.split(PATH, "/")
        head: list[str] = []
        for segment in collection.path:
            if isinstance(segment, Field):
                break
            head.append(segment)
        condition: Column = F.col(PATH).startswith("/".join(head) + "/") & (F.size(parts) == size + 1)
        for i, segment in enumerate(collection.path):
            if i >= len(head) and not isinstance(segment, Field):
                condition &= parts[i] == segment
        return table.where(condition), [(i, s) for i, s in enumerate(collection.path) if isinstance(s, Field)]

    @staticmethod
    def _fits(registered: str, collection: Collection) -> bool:
        """Whether the collection names of a registered path are those asked for."""
        own = registered.split("/")
        asked = [s for s in collection.path[::2]]
        return own == list(asked) or (len(own) == len(collection.path) and all(isinstance(b, Field) or a == b for a, b in zip(own, collection.path, strict=True)))


def metadata(path: Column, names: tuple[str, ...]) -> Column:
    """``#id``, ``#path``, ``#collection`` and ``#parent`` steps over a document path.

    Level k above is the path without its last 2k segments; NULL where there is none.
    """
    level = 0
    while names[0] == "#parent" and len(names) > 1:
        level, names = level + 1, names[1:]
    name, rest = names[0], names[1:]
    if rest or name not in ("#id", "#path", "#collection", "#parent"):
        raise ValueError(f"Unknown metadata field: {'.'.join(names)}")
    parts = F.split(path, "/")
    if name == "#id":
        return F.try_element_at(parts, F.lit(-1 - 2 * level))
    if name == "#collection":
        return F.try_element_at(parts, F.lit(-2 - 2 * level))
    if name == "#parent":
        level += 1
    if not level:
        return path
    size = F.size(parts) - 2 * level
    return F.when(size > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(size, F.lit(0))), "/"))

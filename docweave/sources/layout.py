"""Index definitions, kept as a description of how tables are laid out.

Spark has no secondary indexes; a match tells ``explain`` whether a filter and
order agree with the declared sort columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

MODES = ("ASCENDING", "DESCENDING", "ARRAY_CONTAINS")


@dataclass(frozen=True)
class Index:
    collection: str
    fields: tuple[tuple[str, str], ...]
    scope: str = "COLLECTION"


@dataclass(frozen=True)
class IndexMatch:
    type: str = "none"
    index: Index | None = None
    matched: int = 0


class Indexes:
    """A set of definitions that can be asked for the best match of a scan."""

    def __init__(self, definitions: Iterable[Index] = ()):
        self.definitions = list(definitions)

    def add(self, index: Index) -> None:
        self.definitions.append(index)

    def load(self, source: str | Mapping) -> None:
        """From JSON text or the parsed object: ``indexes`` with collectionGroup, queryScope, fields."""
        for x in (json.loads(source) if isinstance(source, str) else source).get("indexes", []):
            modes = (("ARRAY_CONTAINS" if f.get("arrayConfig") == "CONTAINS" and f.get("order") != "DESCENDING" else f.get("order") or "ASCENDING") for f in x["fields"])
            self.add(Index(x["collectionGroup"], tuple(zip((f["fieldPath"] for f in x["fields"]), modes, strict=True)), x.get("queryScope", "COLLECTION")))

    def of(self, collection: str) -> list[Index]:
        return [i for i in self.definitions if i.collection == collection]

    def match(self, collection: str, constraints: Iterable[tuple[str, str]], order: tuple[str, str] | None = None) -> IndexMatch:
        """The best index for (field, operator) constraints and a (field, direction) order.

        Equalities must fill the index from its front, then one range field may
        follow, then the order. Exact beats partial, then more fields win.
        """
        constraints = list(constraints)
        equal = {f for f, op in constraints if op in ("==", "array-contains")}
        ranged = next((f for f, op in constraints if op not in ("==", "array-contains")), None)
        best = IndexMatch()
        for index in self.of(collection):
            names = [f for f, _ in index.fields]
            n = next((i for i, f in enumerate(names) if f not in equal), len(names))
            in_range = ranged is not None and names[n : n + 1] == [ranged]
            at = n if in_range or ranged is None else None
            sorts = order is None
            if order is not None:
                slot = n if in_range or ranged is None else n
                sorts = index.fields[slot : slot + 1] == ((order[0], "ASCENDING" if order[1] == "asc" else "DESCENDING"),)
            used = n + in_range + (order is not None and sorts and not in_range)
            if not (n or in_range or (order is not None and sorts)):
                continue
            exact = n == len(equal) and at is not None and sorts
            match = IndexMatch("exact" if exact else "partial", index, int(used))
            if (match.type == "exact", match.matched) > (best.type == "exact", best.matched) or best.type == "none":
                best = match
        return best

    @staticmethod
    def cost(match: IndexMatch) -> int:
        """The planner's unitless cost of a scan."""
        return {"exact": 1, "partial": max(1, 10 - match.matched) + 5}.get(match.type, 1000)

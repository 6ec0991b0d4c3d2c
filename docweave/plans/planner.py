"""Projections as DataFrames."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import And, Collection, Comparison, Field, Or, Predicate, Projection, aliases
from ..operators import contains_join, group_rows, hinted, overlap_join, spread_join, union_all
from ..sources import Catalog
from .columns import Compiler
from .normalize import FALSE, TRUE, bind, conjuncts, disjuncts, normalize

RANGES = ("<", "<=", ">", ">=")
MEMBERSHIP = ("in", "array-contains", "array-contains-any")


class Planner:
    """Declares the plan of a query; which physical operators run it is Spark's choice."""

    def __init__(self, catalog: Catalog, two_valued: bool = False, strict: bool = True):
        self.catalog, self.two_valued, self.strict = catalog, two_valued, strict

    def where(self, query: Projection) -> Predicate:
        """The predicate as it will be planned."""
        p = query.where or TRUE
        if query.predicate_mode == "respect" or self.two_valued:
            return p if isinstance(p, And) else And((p,)) if p != TRUE else TRUE
        return normalize(p)

    def plan(self, query: Projection, params: dict[str, Any] | None = None) -> DataFrame:
        query = bind_query(query, {**query.params, **(params or {})})
        where = self.where(query)
        branches = self.branches(query, where)
        rows = union_all(*(self.rows(query, conjuncts(b)) for b in branches))
        return self.shape(query, rows)

    def branches(self, query: Projection, where: Predicate) -> list[Predicate]:
        """One predicate, or one for each disjunct of an OR.

        A branch takes only rows that no branch before it takes, so their union needs
        no duplicates removed, no row identity and no shuffle.
        """
        if query.predicate_or_mode != "union":
            return [where]
        parts = conjuncts(where)
        choice = next((p for p in parts if isinstance(p, Or)), None)
        if choice is None:
            return [where]
        rest = tuple(p for p in parts if p != choice)
        out, earlier = [], []
        for d in disjuncts(choice):
            out.append(And((*rest, *conjuncts(d), *(Surely(e) for e in earlier))))
            earlier.append(d)
        return out

    # -- rows ---------------------------------------------------------------------------------

    def compiler(self, frame: DataFrame) -> Compiler:
        return _Compiler(frame, two_valued=self.two_valued, strict=self.strict)

    def rows(self, query: Projection, parts: tuple[Predicate, ...]) -> DataFrame:
        """One struct column for each alias: scans with their filters, joined."""
        waiting = list(parts)
        frames: dict[str, DataFrame] = {}
        for alias, collection in query.sources.items():
            table, segments = self.catalog.scan(collection)
            frames[alias] = table.select(F.struct("*").alias(alias))
            waiting += [Comparison("==", Field(alias, (f"#segment:{i}",)), f) for i, f in segments]
        for alias, frame in frames.items():
            mine = [p for p in waiting if needs(p) == {alias}]
            waiting = [p for p in waiting if p not in mine]
            frames[alias] = self.filtered(frame, mine)
        order = list(query.sources)
        done, out = {order[0]}, frames[order[0]]
        while len(done) < len(order):
            left = [a for a in order if a not in done]
            ready = lambda a: [p for p in waiting if a in needs(p) and needs(p) <= done | {a}]  # noqa: B023, E731
            alias = min(left, key=lambda a: (-max((self.rank(p) for p in ready(a)), default=0), order.index(a)))
            now = ready(alias)
            waiting = [p for p in waiting if p not in now]
            out = self.joined(out, done, frames[alias], alias, now, query.join, query.sources)
            done.add(alias)
        return self.filtered(out, waiting)

    @staticmethod
    def rank(p: Predicate) -> int:
        """How well a predicate connects two sides: equality, membership, anything."""
        if isinstance(p, Comparison):
            return 3 if p.op == "==" else 2 if p.op in MEMBERSHIP else 1
        return 1

    def filtered(self, frame: DataFrame, parts: list[Predicate]) -> DataFrame:
        if FALSE in parts:
            return frame.where(F.lit(False))
        make = self.compiler(frame)
        for p in parts:
            frame = frame.where(make.predicate(p))
        return frame

    def joined(self, left: DataFrame, done: set[str], right: DataFrame, alias: str, parts: list[Predicate], hint: str, sources: dict[str, Collection]) -> DataFrame:
        if not parts:
            warnings.warn(f"No predicate joins {alias!r}: every pair of rows is in the result", stacklevel=4)
            return left.crossJoin(right)
        flat = [q for p in parts for q in conjuncts(p)]
        sided = [p for p in flat if isinstance(p, Comparison) and self.sides(p, done, alias)]
        check_hint(hint, sided, flat)
        # the columns of both sides have different names, so one schema serves both
        make = self.compiler(_beside(left, right))
        equal = any(p.op == "==" for p in sided)
        member = None if equal else next((p for p in sided if p.op in MEMBERSHIP and self.typed_member(make, p)), None)
        if hint == "nested-loop" and (equal or member is not None):
            hint = "auto"  # all pairs are compared only where rows can't meet by a key; the result is the same
        if member is not None:
            return self.member_join(make, left, done, right, member, [p for p in parts if p != member], hint)
        keys = self.shared_keys(make, left, done, right, alias, flat, sources)
        if keys:
            rest = [make.predicate(p) for p in flat if p not in keys]
            a, b = zip(*keys.values(), strict=True)
            return spread_join(left, [*a], self.told(left, *done, sources), right, [*b], self.told(right, alias, sources), reduce(lambda p, q: p & q, rest) if rest else None, hint)
        condition = reduce(lambda a, b: a & b, map(make.predicate, parts))
        return left.join(hinted(right, hint), condition)

    def shared_keys(self, make: Compiler, left: DataFrame, done: set[str], right: DataFrame, alias: str, flat: list[Predicate], sources: dict[str, Collection]) -> dict[Comparison, tuple[Column, Column]]:
        """The equalities of two collections as columns of both, if many documents of
        either may share a key; none if a key is an identity, so that one of the sides
        has a partner at the most. What was joined before isn't read twice to count keys."""
        found: dict[Comparison, tuple[Column, Column]] = {}
        if len(done) > 1 or left.isStreaming or right.isStreaming:
            return found
        own = {a: self.catalog.identity(sources[a])[1] for a in (*done, alias)}
        for p in flat:
            if not (isinstance(p, Comparison) and p.op == "==" and self.sides(p, done, alias)):
                continue
            if any(isinstance(x, Field) and len(x.path) == 1 and x.path[0] in own[x.source] for x in (p.left, p.right)):
                return {}
            (a, s), (b, t) = (make.typed(x) for x in ((p.left, p.right) if aliases(p.left) <= done else (p.right, p.left)))
            if s == t:
                found[p] = a, b
            elif isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType):
                found[p] = a.cast("long"), b.cast("long")
            elif isinstance(s, T.StringType) and isinstance(t, T.NumericType) or isinstance(s, T.NumericType) and isinstance(t, T.StringType):
                found[p] = make.alike((a, s), (b, t))
        # counted and joined rows must have the same keys
        same = all(f.select("*", *(k[i] for k in found.values()))._jdf.queryExecution().analyzed().deterministic() for i, f in enumerate((left, right)))
        return found if same else {}

    def told(self, frame: DataFrame, alias: str, sources: dict[str, Collection]) -> list[Column]:
        """Columns that tell the documents of a collection apart: its identity, or numbers and
        dates, which are read faster than text; text only where there is nothing else."""
        own, row = self.catalog.identity(sources[alias])[0], F.col(f"`{alias}`")
        kinds = {f.name: f.dataType for f in frame.schema[alias].dataType.fields}
        fixed = [n for n, k in kinds.items() if isinstance(k, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType)]
        names = [own] if own else fixed or [n for n, k in kinds.items() if isinstance(k, T.StringType | T.BinaryType)]
        return [row.getField(n) for n in names]

    @staticmethod
    def sides(p: Comparison, done: set[str], alias: str) -> bool:
        """Whether one operand is of the new alias and the other of those before it."""
        a, b = aliases(p.left), aliases(p.right)
        return bool(a and b) and ((a <= done and b == {alias}) or (a == {alias} and b <= done))

    @staticmethod
    def typed_member(make: Compiler, p: Comparison) -> bool:
        """Whether the operands are an array and its elements, or two arrays, of one type."""
        if isinstance(p.right, tuple):
            return False
        array, other = (p.right, p.left) if p.op == "in" else (p.left, p.right)
        kind, own = make.typed(array)[1], make.typed(other)[1]
        if not isinstance(kind, T.ArrayType):
            return False
        return kind.elementType == (own.elementType if isinstance(own, T.ArrayType) and p.op == "array-contains-any" else own)

    def member_join(self, make: Compiler, left: DataFrame, done: set[str], right: DataFrame, p: Comparison, others: list[Predicate], hint: str) -> DataFrame:
        rest = reduce(lambda a, b: a & b, map(make.predicate, others)) if others else None
        if p.op == "array-contains-any":
            a, b = (p.left, p.right) if aliases(p.left) <= done else (p.right, p.left)
            return overlap_join(left, make.column(a), right, make.column(b), rest, hint)
        array, value = (p.right, p.left) if p.op == "in" else (p.left, p.right)
        arrays, values = (left, right) if aliases(array) <= done else (right, left)
        out = contains_join(arrays, make.column(array), values, make.column(value), rest, hint)
        return out.select(*left.columns, *right.columns)

    # -- result -------------------------------------------------------------------------------

    def shape(self, query: Projection, rows: DataFrame) -> DataFrame:
        make = self.compiler(rows)
        if query.group_by is not None or query.aggregates is not None:
            keys = query.group_by or {}
            wanted = query.aggregates if query.aggregates is not None else {"count": None}
            made = {n: ("count", None) if a is None else (a.fn, make.column(a.operand) if a.operand is not None else None) for n, a in wanted.items()}
            out = group_rows(rows, {k: make.column(e) for k, e in keys.items()}, made)
            by = []
            for o in query.order_by:
                name = next((k for k, e in keys.items() if e == o.by), None)
                if name is None:
                    raise ValueError("A grouped query is ordered by its group_by expressions")
                by.append(_ordered(F.col(f"`{name}`"), o.direction))
            return _page(out.orderBy(*by) if by else out, query)
        if query.order_by:
            rows = rows.orderBy(*(_ordered(make.column(o.by), o.direction) for o in query.order_by))
        unique = bool(query.unique_by)
        if not unique:
            rows = _page(rows, query)
        out = rows if query.select is None else rows.select(*(make.column(e).alias(k) for k, e in query.select.items()))
        if unique:
            out = out.dropDuplicates([*query.unique_by])
            if query.order_by and query.select is not None:
                names = [(next((k for k, e in query.select.items() if e == o.by), None), o.direction) for o in query.order_by]
                if None in (n for n, _ in names):
                    raise ValueError("With unique_by, a query is ordered by expressions that it selects")
                out = out.orderBy(*(_ordered(F.col(f"`{n}`"), d) for n, d in names))
            out = _page(out, query)
        return out


class Surely(Predicate):
    """Rows for which a predicate is not true: false or NULL."""

    def __init__(self, inner: Predicate):
        self.inner = inner


class _Compiler(Compiler):
    def predicate(self, p: Predicate) -> Column:
        if isinstance(p, Surely):
            return ~F.coalesce(super().predicate(p.inner), F.lit(False))
        return super().predicate(p)


def needs(p: Predicate) -> set[str]:
    return aliases(p.inner) if isinstance(p, Surely) else aliases(p)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """An empty frame with the columns of both sides, to resolve names and types only."""
    return left.sparkSession.createDataFrame([], T.StructType([*left.schema.fields, *right.schema.fields]))


def _ordered(column: Column, direction: str) -> Column:
    """NULL is smallest."""
    return column.asc_nulls_first() if direction == "asc" else column.desc_nulls_last()


def _page(frame: DataFrame, query: Projection) -> DataFrame:
    if query.offset:
        frame = frame.offset(query.offset)
    return frame if query.limit is None else frame.limit(query.limit)


def bind_query(query: Projection, params: dict[str, Any]) -> Projection:
    """The query with values for its parameters."""
    put = lambda e: bind(e, params)
    one = lambda e: e[0] if isinstance(e := put(e), tuple) and len(e) == 1 else e
    return replace(
        query,
        select=None if query.select is None else {k: one(e) for k, e in query.select.items()},
        where=None if query.where is None else put(query.where),
        order_by=tuple(replace(o, by=one(o.by)) for o in query.order_by),
        group_by=None if query.group_by is None else {k: one(e) for k, e in query.group_by.items()},
        aggregates=None if query.aggregates is None else {k: replace(a, operand=None if a.operand is None else one(a.operand)) for k, a in query.aggregates.items()},
    )


def check_hint(hint: str, sided: list[Comparison], flat: list[Predicate]) -> None:
    """Complain about a strategy that can't run the join."""
    if hint == "hash" and not any(p.op == "==" or p.op in MEMBERSHIP for p in sided):
        raise ValueError("Hash join hint is incompatible with the provided join predicate.")
    if hint == "merge" and not any(p.op == "==" or p.op in RANGES for p in sided):
        raise ValueError("Merge join hint is incompatible with the provided join predicate.")
    if hint == "indexed-nested-loop" and not any(isinstance(p.left, Field) and isinstance(p.right, Field) for p in flat if isinstance(p, Comparison)):
        raise ValueError("Indexed nested-loop join requires a conjunctive join predicate containing Field-vs-Field comparisons.")


def inequality_guard(query: Projection, where: Predicate) -> None:
    """An optional check of a document store's limits: ranges on one field of a source,
    which the first order entry must name."""
    for alias in query.sources:
        ranged = list(dict.fromkeys(p.left for p in conjuncts(where) if isinstance(p, Comparison) and p.op in (*RANGES, "!=", "not-in") and isinstance(p.left, Field) and p.left.source == alias and not aliases(p.right)))
        if len(ranged) > 1:
            raise ValueError(f"Source {alias!r} has range conditions on several fields: {', '.join(map(str, ranged))}")
        first = next((o.by for o in query.order_by if isinstance(o.by, Field) and o.by.source == alias), None)
        if ranged and first is not None and first != ranged[0]:
            raise ValueError(f"The first order of source {alias!r} must be its range field {ranged[0]}")



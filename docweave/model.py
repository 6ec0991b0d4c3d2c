"""Query objects: expressions, predicates, collections and projections.

Everything here is plain immutable data. Nothing touches Spark; the modules in
``plans`` turn these objects into columns and DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field as _attribute
from typing import Any

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "not-in", "array-contains", "array-contains-any")
JOIN_HINTS = ("auto", "hash", "merge", "nested-loop", "indexed-nested-loop")
PREDICATE_MODES = ("auto", "respect")
OR_MODES = ("auto", "union", "single-scan")
ORDER_HINTS = ("auto", "db-side", "post-fetch-sort")
METADATA = ("#id", "#path", "#collection", "#parent")


class Expression:
    """A value for each row."""


@dataclass(frozen=True)
class Field(Expression):
    """``alias.path.to.leaf``; a step that begins with # is metadata."""

    source: str
    path: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join((self.source, *self.path))


@dataclass(frozen=True)
class Literal(Expression):
    value: str | int | float | bool | None

    def __post_init__(self) -> None:
        if not isinstance(self.value, str | int | float | bool | type(None)):
            raise TypeError(f"literal() takes a string, number, boolean or None, not {type(self.value).__name__}")

    # 1, 1.0 and True are equal in Python; as literals a boolean is none of the others
    def __eq__(self, other: object) -> bool:
        return isinstance(other, Literal) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    @property
    def key(self) -> tuple:
        kind = "null" if self.value is None else "bool" if isinstance(self.value, bool) else "str" if isinstance(self.value, str) else "num"
        return kind, self.value


@dataclass(frozen=True)
class Param(Expression):
    """A placeholder that gets its value when the query is bound."""

    name: str


@dataclass(frozen=True)
class Function(Expression):
    """``fn`` over (nested lists of) expressions.

    Without ``return_type`` fn maps columns to a column, which Catalyst sees
    through. With it, fn is an ordinary Python function of values.
    """

    name: str
    fn: Callable
    inputs: Any
    return_type: str | None = None
    deterministic: bool = True


class Predicate:
    """A condition on each row."""


@dataclass(frozen=True)
class Comparison(Predicate):
    op: str
    left: Expression
    right: Expression | tuple[Expression, ...]


@dataclass(frozen=True)
class Like(Predicate):
    left: Expression
    pattern: Expression


@dataclass(frozen=True)
class NotNull(Predicate):
    operand: Expression


@dataclass(frozen=True)
class And(Predicate):
    items: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    items: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    item: Predicate


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


@dataclass(frozen=True)
class Custom(Predicate):
    """A boolean function over (nested lists of) expressions; ``python`` as for Function with a type."""

    inputs: Any
    fn: Callable
    metadata: Any = None
    python: bool = False


@dataclass(frozen=True)
class Aggregate:
    """One of count, sum, avg, min, max, count_distinct over an expression (count: optional)."""

    fn: str
    operand: Expression | None = None


@dataclass(frozen=True)
class Order:
    by: Expression
    direction: str = "asc"


@dataclass(frozen=True)
class Collection:
    """Path segments, literal or taken from a field; ``group`` as forced, or unknown for nested paths."""

    path: tuple[str | Field, ...]
    group: bool | None


def field(name: str) -> Field:
    if not isinstance(name, str):
        raise TypeError("field() expects a string such as 'alias.path'")
    source, *path = name.split(".")
    if not source or not path or not all(path):
        raise ValueError(f"field() must include alias and path: {name!r}")
    return Field(source, tuple(path))


def literal(value: Any) -> Literal:
    return Literal(value)


def param(name: str) -> Param:
    return Param(name)


def expression(value: Any) -> Expression:
    """Plain Python values become literals."""
    return value if isinstance(value, Expression) else Literal(value)


def nested(value: Any) -> Any:
    """The same for nested lists, as tuples."""
    return tuple(nested(v) for v in value) if isinstance(value, list | tuple) else expression(value)


def _members(values: Any) -> Expression | tuple[Expression, ...]:
    if isinstance(values, Expression):
        return values
    if isinstance(values, str) or not isinstance(values, Iterable):
        raise TypeError("in / not-in / array-contains-any requires right operand to be an array")
    return tuple(expression(v) for v in values)


def eq(left: Any, right: Any) -> Comparison:
    return Comparison("==", expression(left), expression(right))


def ne(left: Any, right: Any) -> Comparison:
    return Comparison("!=", expression(left), expression(right))


def lt(left: Any, right: Any) -> Comparison:
    return Comparison("<", expression(left), expression(right))


def lte(left: Any, right: Any) -> Comparison:
    return Comparison("<=", expression(left), expression(right))


def gt(left: Any, right: Any) -> Comparison:
    return Comparison(">", expression(left), expression(right))


def gte(left: Any, right: Any) -> Comparison:
    return Comparison(">=", expression(left), expression(right))


def array_contains(array: Any, value: Any) -> Comparison:
    return Comparison("array-contains", expression(array), expression(value))


def array_contains_any(array: Any, values: Any) -> Comparison:
    return Comparison("array-contains-any", expression(array), _members(values))


def in_list(value: Any, values: Any) -> Comparison:
    return Comparison("in", expression(value), _members(values))


def not_in_list(value: Any, values: Any) -> Comparison:
    return Comparison("not-in", expression(value), _members(values))


def and_(items: Iterable[Predicate]) -> And:
    return And(tuple(items))


def or_(items: Iterable[Predicate]) -> Or:
    return Or(tuple(items))


def not_(item: Predicate) -> Not:
    return Not(item)


def constant(value: bool) -> Constant:
    return Constant(bool(value))


def compare(inputs: Any, fn: Callable, metadata: Any = None, python: bool = False) -> Custom:
    return Custom(nested(inputs), fn, metadata, python)


def like(left: Any, pattern: Any) -> Like:
    return Like(expression(left), expression(pattern))


def _collection(path: str, force: bool) -> Collection:
    parts = [p for p in path.split("/") if p]
    segments = tuple(field(m[1]) if (m := re.fullmatch(r"\{(.+)\}", p)) else p for p in parts)
    return Collection(segments, True if force else False if len(parts) < 2 else None)


def collection(path: str) -> Collection:
    """A collection by its path; ``{alias.field}`` takes a segment from another source."""
    return _collection(path, False)


def collection_group(name: str) -> Collection:
    """All collections whose last segment is ``name``."""
    return _collection(name, True)


@dataclass(frozen=True)
class Projection:
    """A query. Build it with ``projection``."""

    id: str
    sources: Mapping[str, Collection]
    select: Mapping[str, Expression] | None = None
    where: Predicate | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    join: str = "auto"
    predicate_mode: str = "auto"
    predicate_or_mode: str = "auto"
    order_hint: str = "auto"
    group_by: Mapping[str, Expression] | None = None
    aggregates: Mapping[str, Aggregate] | None = None
    params: Mapping[str, Any] = _attribute(default_factory=dict)
    materialize_to: str | None = None
    unique_by: tuple[str, ...] = ()
    key: str | None = None


def fields(node: Any) -> Iterator[Field]:
    """Every field inside expressions, predicates and (nested) lists of them."""
    if isinstance(node, Field):
        yield node
    elif isinstance(node, tuple | list):
        for x in node:
            yield from fields(x)
    elif isinstance(node, Function | Custom):
        yield from fields(node.inputs)
    elif isinstance(node, Comparison):
        yield from fields((node.left, node.right))
    elif isinstance(node, Like):
        yield from fields((node.left, node.pattern))
    elif isinstance(node, NotNull):
        yield from fields(node.operand)
    elif isinstance(node, And | Or):
        yield from fields(node.items)
    elif isinstance(node, Not):
        yield from fields(node.item)
    elif isinstance(node, Aggregate):
        yield from fields(node.operand)
    elif isinstance(node, Order):
        yield from fields(node.by)
    elif isinstance(node, Collection):
        yield from fields(node.path)


def aliases(node: Any) -> set[str]:
    return {f.source for f in fields(node)}


def _choice(what: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def projection(
    id: str,
    sources: Mapping[str, Collection | str],
    select: Mapping[str, Any] | None = None,
    where: Predicate | None = None,
    order_by: Iterable[Any] = (),
    limit: int | None = None,
    offset: int | None = None,
    hints: Mapping[str, str] | None = None,
    group_by: Mapping[str, Any] | None = None,
    aggregates: Mapping[str, Aggregate | tuple] | None = None,
    params: Mapping[str, Any] | None = None,
    materialize_to: str | None = None,
    unique_by: Iterable[str] = (),
    key: str | None = None,
) -> Projection:
    """Build and validate a query.

    ``order_by`` entries are expressions (ascending) or (expression, direction).
    ``aggregates`` are Aggregate or (function, expression). ``params`` are
    defaults. ``materialize_to`` is a Parquet path, written when the query runs.
    ``unique_by`` names result columns that no two rows share.
    """
    if not sources:
        raise ValueError("Projection requires at least one source alias")
    hints = dict(hints or {})
    if unknown := set(hints) - {"join", "predicate_mode", "predicate_or_mode", "order_by"}:
        raise ValueError(f"Unknown hints: {', '.join(sorted(unknown))}")
    for name, count in (("limit", limit), ("offset", offset)):
        if count is not None and (isinstance(count, bool) or not isinstance(count, int) or count < 0):
            raise ValueError(f"{name} must be a number of rows")
    order = tuple(o if isinstance(o, Order) else Order(expression(o[0]), o[1]) if isinstance(o, tuple) else Order(expression(o)) for o in order_by)
    for o in order:
        _choice("direction", o.direction, ("asc", "desc"))
    out = Projection(
        id=id,
        sources={a: c if isinstance(c, Collection) else collection(c) for a, c in sources.items()},
        select={k: expression(v) for k, v in select.items()} if select is not None else None,
        where=where,
        order_by=order,
        limit=limit,
        offset=offset,
        join=_choice("join hint", hints.get("join", "auto"), JOIN_HINTS),
        predicate_mode=_choice("predicate mode", hints.get("predicate_mode", "auto"), PREDICATE_MODES),
        predicate_or_mode=_choice("OR mode", hints.get("predicate_or_mode", "auto"), OR_MODES),
        order_hint=_choice("order hint", hints.get("order_by", "auto"), ORDER_HINTS),
        group_by={k: expression(v) for k, v in group_by.items()} if group_by is not None else None,
        aggregates={k: a if isinstance(a, Aggregate) else Aggregate(a[0], expression(a[1]) if len(a) > 1 else None) for k, a in aggregates.items()} if aggregates is not None else None,
        params=dict(params or {}),
        materialize_to=materialize_to,
        unique_by=tuple(unique_by),
        key=key,
    )
    used = aliases([*(out.select or {}).values(), out.where, *out.order_by, *(out.group_by or {}).values(), *(out.aggregates or {}).values(), *out.sources.values()])
    if unknown := used - set(out.sources):
        raise ValueError(f"Projection {id!r} references unknown alias {', '.join(map(repr, sorted(unknown)))}")
    return out

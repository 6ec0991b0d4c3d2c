"""Expressions and predicates as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import And, Comparison, Constant, Custom, Expression, Field, Function, Like, Literal, Not, NotNull, Or, Param, Predicate
from ..sources.catalog import PATH, metadata

LITERALS = {"str": T.StringType(), "bool": T.BooleanType(), "null": T.NullType()}


def walk(column: Column, kind: T.DataType, path: tuple[str, ...], strict: bool) -> tuple[Column, T.DataType]:
    """Follow a path. Through an array, the rest of the path maps over the elements:
    NULLs are dropped, arrays in arrays are flattened, and nothing left is NULL."""
    if not path:
        return column, kind
    if isinstance(kind, T.StructType):
        if path[0] not in kind.names:
            if strict:
                raise ValueError(f"No field {path[0]!r} among {', '.join(kind.names)}")
            return F.lit(None), T.NullType()
        return walk(column.getField(path[0]), kind[path[0]].dataType, path[1:], strict)
    if isinstance(kind, T.MapType):
        return walk(F.try_element_at(column, F.lit(path[0])), kind.valueType, path[1:], strict)
    if isinstance(kind, T.ArrayType):
        inner: list[T.DataType] = []

        def step(x: Column) -> Column:
            out, found = walk(x, kind.elementType, path, strict)
            inner.append(found)
            return out

        mapped = F.filter(F.transform(column, step), lambda x: x.isNotNull())
        found = inner[0]
        if isinstance(found, T.ArrayType):
            mapped = F.filter(F.flatten(mapped), lambda x: x.isNotNull())
            found = found.elementType
        return F.when(F.size(mapped) > 0, mapped), T.ArrayType(found)
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$" + "".join(f'["{p}"]' for p in path), "string"), T.StringType()
    if strict:
        raise ValueError(f"{path[0]!r} can't be read from a value of type {kind.simpleString()}")
    return F.lit(None), T.NullType()


def _kind(t: T.DataType | None) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.StringType | T.VarcharType | T.CharType):
        return "str"
    return "bool" if isinstance(t, T.BooleanType) else "null" if isinstance(t, T.NullType) else "other"


class Compiler:
    """Columns over ``frame``, which has one struct column for each alias.

    ``two_valued`` makes every leaf TRUE or FALSE, so that a negation selects what
    its operand doesn't; else NULL follows SQL. Without ``strict``, unknown fields
    are NULL.
    """

    def __init__(self, frame: DataFrame, params: dict[str, Any] | None = None, two_valued: bool = False, strict: bool = True):
        self.frame, self.params, self.two_valued, self.strict = frame, params or {}, two_valued, strict
        self.schema = {f.name: f.dataType for f in frame.schema.fields}

    def typed(self, e: Expression) -> tuple[Column, T.DataType]:
        if isinstance(e, Literal):
            kind = LITERALS.get(e.key[0]) or (T.DoubleType() if isinstance(e.value, float) else T.LongType())
            return F.lit(e.value), kind
        if isinstance(e, Param):
            if e.name not in self.params:
                raise KeyError(f'Parameter "{e.name}" was not provided.')
            return self.typed(Literal(self.params[e.name]))
        if isinstance(e, Field):
            return self.field(e)
        if isinstance(e, Function):
            column = self.call(e)
            return column, self.frame.select(column).schema[0].dataType
        raise TypeError(f"Unsupported expression: {e!r}")

    def column(self, e: Expression) -> Column:
        return self.call(e) if isinstance(e, Function) else self.typed(e)[0]

    def field(self, f: Field) -> tuple[Column, T.DataType]:
        if f.source not in self.schema:
            raise ValueError(f"Unknown alias {f.source!r}")
        row = F.col(f"`{f.source}`")
        if f.path[0].startswith("#segment:"):
            return F.get(F.split(row.getField(PATH), "/"), int(f.path[0].partition(":")[2])), T.StringType()
        if f.path[0].startswith("#"):
            return metadata(row.getField(PATH), f.path), T.StringType()
        return walk(row, self.schema[f.source], f.path, self.strict)

    def shape(self, inputs: Any, leaf: Callable[[Expression], Any]) -> Any:
        return [self.shape(x, leaf) for x in inputs] if isinstance(inputs, tuple) else leaf(inputs)

    def call(self, f: Function) -> Column:
        if f.return_type:
            return self.python(f.inputs, f.fn, f.return_type, f.deterministic)
        if f.name == "concatenate":
            return f.fn([self.text(x) for x in f.inputs])
        if f.name == "add" and any(_kind(self.typed(x)[1]) == "str" for x in f.inputs):
            return F.concat(*(self.text(x) for x in f.inputs))
        return f.fn(self.shape(f.inputs, self.column))

    def text(self, e: Expression) -> Column:
        """A value as text; a double without a fraction as a whole number."""
        column, kind = self.typed(e)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return F.when((column == F.floor(column)) & (F.abs(column) < 1e15), column.cast("long").cast("string")).otherwise(column.cast("string"))
        return column.cast("string")

    def python(self, inputs: Any, fn: Callable, kind: str, deterministic: bool = True) -> Column:
        """A Python function over Arrow batches; nested inputs travel flat and get their shape back."""
        flat: list[Column] = []

        def number(e: Expression) -> int:
            flat.append(self.column(e))
            return len(flat) - 1

        shape = self.shape(inputs, number)

        def rebuild(x: Any, values: tuple) -> Any:
            return [rebuild(y, values) for y in x] if isinstance(x, list) else values[x]

        udf = F.udf(lambda *values: fn(rebuild(shape, values)), kind, useArrow=True)
        return (udf if deterministic else udf.asNondeterministic())(*flat)

    # -- predicates ---------------------------------------------------------------------------

    def predicate(self, p: Predicate) -> Column:
        if isinstance(p, And):
            return reduce(lambda a, b: a & b, map(self.predicate, p.items), F.lit(True)) if len(p.items) != 1 else self.predicate(p.items[0])
        if isinstance(p, Or):
            return reduce(lambda a, b: a | b, map(self.predicate, p.items), F.lit(False)) if len(p.items) != 1 else self.predicate(p.items[0])
        if isinstance(p, Not):
            return ~self.predicate(p.item)
        if isinstance(p, Constant):
            return F.lit(p.value)
        if isinstance(p, NotNull):
            return self.column(p.operand).isNotNull()
        if isinstance(p, Like):
            out = self.like(p)
        elif isinstance(p, Custom):
            out = self.python(p.inputs, p.fn, "boolean") if p.python else p.fn(self.shape(p.inputs, self.column))
        elif isinstance(p, Comparison):
            out = self.comparison(p)
        else:
            raise TypeError(f"Unsupported expression in predicate: {p!r}")
        return F.coalesce(out, F.lit(False)) if self.two_valued else out

    def like(self, p: Like) -> Column:
        """% and _ as in SQL, without an escape character: it is one that no pattern holds."""
        pattern = p.pattern.value if isinstance(p.pattern, Literal) else None
        escape = next(c for c in map(chr, range(1, 32)) if c not in (pattern or ""))
        return F.like(self.column(p.left), self.column(p.pattern), F.lit(escape))

    def comparison(self, p: Comparison) -> Column:
        op = p.op
        if op in ("in", "not-in"):
            found = self.member(p.left, p.right)
            return found if op == "in" else ~found
        if op == "array-contains":
            return self.contains(p.left, p.right)
        if op == "array-contains-any":
            return self.overlaps(p.left, p.right)
        if op in ("==", "!=") and isinstance(p.right, Literal) and p.right.value is None:
            left = self.column(p.left)
            return left.isNull() if op == "==" else left.isNotNull()
        a, b = self.alike(self.typed(p.left), self.typed(p.right))
        if op == "!=" and self.two_valued:
            return ~a.eqNullSafe(b)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    @staticmethod
    def alike(left: tuple[Column, T.DataType], right: tuple[Column, T.DataType]) -> tuple[Column, Column]:
        """Operands that compare without an error: text against numbers is read as a number where it is one."""
        (a, s), (b, t) = left, right
        kinds = {_kind(s), _kind(t)}
        if kinds == {"str", "num"}:
            read = lambda c, k: c.try_cast("double") if _kind(k) == "str" else c.cast("double")
            return read(a, s), read(b, t)
        if "bool" in kinds and len(kinds - {"null", "other"}) > 1:
            raise TypeError(f"Can't compare {s.simpleString()} with {t.simpleString()}")
        return a, b

    def member(self, value: Expression, among: Any) -> Column:
        if isinstance(among, Expression):
            _, kind = self.typed(among)
            if isinstance(kind, T.ArrayType):
                return self.contains(among, value)
            return self.comparison(Comparison("==", value, among))
        if not among:
            return F.lit(False)
        typed = self.typed(value)
        same = [x for x in among if isinstance(x, Literal) and x.value is not None and _kind(self.typed(x)[1]) == _kind(typed[1])]
        parts = [typed[0].isin([x.value for x in same])] if same else []
        for x in among:
            if x not in same:
                if x == Literal(None):
                    parts.append(F.lit(None).cast("boolean"))
                elif isinstance(x, Field) and isinstance(self.field(x)[1], T.ArrayType):
                    parts.append(self.contains(x, value))
                else:
                    a, b = self.alike(typed, self.typed(x))
                    parts.append(a == b)
        return reduce(lambda a, b: a | b, parts)

    def contains(self, array: Expression, value: Expression) -> Column:
        """Strict membership: a value of another kind, or in what isn't an array, is not found."""
        a, kind = self.typed(array)
        v, own = self.typed(value)
        if isinstance(own, T.NullType):
            return F.lit(None).cast("boolean")
        if not isinstance(kind, T.ArrayType) or (_kind(kind.elementType) != _kind(own) and "other" not in (_kind(kind.elementType), _kind(own))):
            return F.lit(False)
        if _kind(own) == "num" and kind.elementType != own:
            a, v = a.cast("array<double>"), v.cast("double")
        return F.array_contains(a, v)

    def overlaps(self, array: Expression, among: Any) -> Column:
        a, kind = self.typed(array)
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        if isinstance(among, Expression):
            b, other = self.typed(among)
            if not isinstance(other, T.ArrayType) or _kind(other.elementType) != _kind(kind.elementType):
                return F.lit(False)
            if kind != other and _kind(kind.elementType) == "num":
                a, b = a.cast("array<double>"), b.cast("array<double>")
            return F.arrays_overlap(a, b)
        fixed = [x for x in among if not (isinstance(x, Literal) and x.value is None) and _kind(self.typed(x)[1]) in (_kind(kind.elementType), "other")]
        if not fixed:
            return F.lit(False)
        values = F.array(*(self.column(x) for x in fixed))
        if _kind(kind.elementType) == "num":
            return F.arrays_overlap(a.cast("array<double>"), values.cast("array<double>"))
        return F.arrays_overlap(a, values)

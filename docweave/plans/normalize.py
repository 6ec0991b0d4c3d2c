"""Rewrites of predicates that Catalyst doesn't do itself.

The values that a field may take form a set on an ordered line, a list of cuts.
Conjunctions intersect such sets and disjunctions unite them, which covers bounds,
lists and their negations at once. A rewritten predicate selects the same rows
under SQL's three-valued logic: negations are first pushed down to the leaves, where
they are exact, and above them NULL and FALSE both mean "not selected".
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from ..model import And, Comparison, Constant, Custom, Expression, Field, Function, Like, Literal, Not, NotNull, Or, Param, Predicate

TRUE, FALSE = Constant(True), Constant(False)
INVERSE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "in": "not-in", "not-in": "in"}
MIRROR = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
LOW, HIGH = (-1,), (1,)


# -- sets of values: sorted, disjoint pairs of cuts -------------------------------------------


def _point(v: Any) -> tuple:
    return (0, v, 0), (0, v, 1)


def unite(sets: Iterable[tuple]) -> tuple:
    out: list[list] = []
    for a, b in sorted(pair for s in sets for pair in s):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple(map(tuple, out))


def complement(values: tuple) -> tuple:
    edges = [LOW, *(cut for pair in values for cut in pair), HIGH]
    return tuple((a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b)


def intersect(sets: Iterable[tuple]) -> tuple:
    return complement(unite(complement(s) for s in sets))


def values_of(p: Predicate) -> tuple[tuple, tuple] | None:
    """((field, kind of literal), set) of a comparison of a field with literals."""
    if not isinstance(p, Comparison) or not isinstance(p.left, Field) or p.op.startswith("array"):
        return None
    listed = isinstance(p.right, tuple)
    items = p.right if listed else (p.right,)
    if listed != (p.op in ("in", "not-in")) or not all(isinstance(i, Literal) for i in items):
        return None
    if not listed and items[0].value is None:
        return None
    kinds = {i.key[0] for i in items} - {"null"}
    if len(kinds) != 1 or any(isinstance(i.value, float) and math.isnan(i.value) for i in items):
        return None
    kind = next(iter(kinds))
    points = unite((_point(i.value),) for i in items if i.value is not None)
    if p.op in ("==", "in"):
        found = points
    elif p.op in ("!=", "not-in"):
        # nothing is surely outside a list that holds NULL
        found = () if any(i.value is None for i in items) else complement(points)
    elif kind == "bool":
        return None
    else:
        below, above = points[0]
        found = {"<": ((LOW, below),), "<=": ((LOW, above),), ">": ((above, HIGH),), ">=": ((below, HIGH),)}[p.op]
    return (p.left, kind), found


def predicate_of(field: Field, values: tuple) -> Predicate:
    """The plainest predicate for a set of values."""
    if not values:
        return FALSE
    single = lambda pair: pair[0][0] == 0 and pair[1][0] == 0 and pair[0][1] == pair[1][1]
    points = [a[1] for a, b in values if single((a, b))]
    ranges = [pair for pair in values if not single(pair)]

    def one_of(op: str, many: str, items: list) -> Predicate:
        return Comparison(op, field, Literal(items[0])) if len(items) == 1 else Comparison(many, field, tuple(map(Literal, items)))

    if not ranges:
        return one_of("==", "in", points)
    holes = [b[1] for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False) if b[0] == 0 and c == (0, b[1], 1) and b[2] == 0]
    if not points and len(holes) == len(ranges) - 1:
        low, high = ranges[0][0], ranges[-1][1]
        parts = [] if low == LOW else [Comparison(">" if low[2] else ">=", field, Literal(low[1]))]
        parts += [] if high == HIGH else [Comparison("<=" if high[2] else "<", field, Literal(high[1]))]
        parts += [one_of("!=", "not-in", holes)] if holes else []
        return parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else NotNull(field)
    return Or(tuple([*([one_of("==", "in", points)] if points else []), *(predicate_of(field, (r,)) for r in ranges)]))


# -- binding and folding ----------------------------------------------------------------------


def bind(node: Any, params: dict[str, Any]) -> Any:
    """Put values in the place of parameters, and call Python functions of values alone."""
    if isinstance(node, tuple | list):
        return tuple(bind(x, params) for x in node)
    if isinstance(node, Param):
        if node.name not in params:
            raise KeyError(f'Parameter "{node.name}" was not provided.')
        value = params[node.name]
        return tuple(map(Literal, value)) if isinstance(value, list | tuple | set) else Literal(value)
    if isinstance(node, Function):
        out = replace(node, inputs=bind(node.inputs, params))
        if out.return_type and out.deterministic and (plain := _plain(out.inputs)) is not None:
            result = out.fn(plain[0])
            if isinstance(result, str | int | float | bool | None):
                return Literal(result)
        return out
    if isinstance(node, Custom):
        return replace(node, inputs=bind(node.inputs, params))
    if isinstance(node, Comparison):
        left, right = bind(node.left, params), bind(node.right, params)
        if isinstance(right, tuple):
            # a parameter may stand for a whole list
            right = tuple(x for item in right for x in (item if isinstance(item, tuple) else (item,)))
            if node.op not in ("in", "not-in", "array-contains-any"):
                raise TypeError(f"{node.op} takes no list")
        elif isinstance(right, Literal) and node.op in ("in", "not-in", "array-contains-any"):
            if right.value is not None:
                raise TypeError(f"{node.op} requires right operand to be an array")
            right = (right,)
        return Comparison(node.op, left, right)
    if isinstance(node, Like):
        return Like(bind(node.left, params), bind(node.pattern, params))
    if isinstance(node, NotNull):
        return NotNull(bind(node.operand, params))
    if isinstance(node, And | Or):
        return type(node)(bind(node.items, params))
    if isinstance(node, Not):
        return Not(bind(node.item, params))
    return node


def _plain(inputs: Any) -> tuple | None:
    """The inputs as Python values in a 1-tuple, if all are literals."""
    if isinstance(inputs, Literal):
        return (inputs.value,)
    if isinstance(inputs, tuple):
        parts = [_plain(x) for x in inputs]
        return None if None in parts else ([p[0] for p in parts],)
    return None


def _fold(p: Comparison) -> Predicate:
    """Put the field on the left, compare literals, take lists apart."""
    left, right, op = p.left, p.right, p.op
    if op in MIRROR and isinstance(left, Literal) and isinstance(right, Expression) and not isinstance(right, Literal):
        left, right, op = right, left, MIRROR[op]
    if isinstance(right, tuple):
        right = tuple(dict.fromkeys(right))
        if not right:
            return TRUE if op == "not-in" else FALSE
        if op != "array-contains-any" and any(not isinstance(x, Literal) for x in right):
            # a listed field may itself be an array, which the comparison sorts out
            fixed = tuple(x for x in right if isinstance(x, Literal))
            parts = [Comparison(op, left, fixed)] if fixed else []
            parts += [Comparison("==" if op == "in" else "!=", left, x) for x in right if not isinstance(x, Literal)]
            return (Or if op == "in" else And)(tuple(_fold(x) for x in parts))
        if len(right) == 1 and isinstance(right[0], Expression):
            if op == "array-contains-any":
                return Comparison("array-contains", left, right[0])
            if right[0] != Literal(None):
                return Comparison({"in": "==", "not-in": "!="}[op], left, right[0])
    if isinstance(left, Literal) and isinstance(right, Literal) and op in MIRROR:
        a, b = left.value, right.value
        if b is None and op in ("==", "!="):
            return Constant((a is None) == (op == "=="))
        if a is None or b is None:
            return FALSE
        if left.key[0] == right.key[0]:
            return Constant({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    if isinstance(left, Literal) and isinstance(right, tuple) and op in ("in", "not-in") and all(isinstance(x, Literal) for x in right):
        if left.value is None:
            return FALSE
        if left in right:
            return Constant(op == "in")
        if {x.key[0] for x in right} == {left.key[0]}:
            return Constant(op == "not-in")
    return Comparison(op, left, right)


def push_not(p: Predicate, negate: bool = False) -> Predicate:
    """Negations only at leaves that have no opposite."""
    if isinstance(p, Not):
        return push_not(p.item, not negate)
    if isinstance(p, And | Or):
        kind = type(p) if not negate else (Or if isinstance(p, And) else And)
        return kind(tuple(push_not(x, negate) for x in p.items))
    if isinstance(p, Constant):
        return Constant(p.value != negate)
    if isinstance(p, Comparison) and negate and p.op in INVERSE:
        if p.op in ("in", "not-in") and not isinstance(p.right, tuple):
            return Not(p)
        return Comparison(INVERSE[p.op], p.left, p.right)
    return Not(p) if negate else p


# -- the simplifier ---------------------------------------------------------------------------


def _flat(kind: type, items: Iterable[Predicate]) -> list[Predicate]:
    out: list[Predicate] = []
    for x in items:
        out += x.items if isinstance(x, kind) else [x]
    return list(dict.fromkeys(out))


def _merge_values(items: list[Predicate], combine: Any) -> list[Predicate]:
    """Combine the sets of each field, where its first predicate stood."""
    sets: dict[tuple, list[tuple]] = {}
    order: list[Any] = []
    for p in items:
        found = values_of(p)
        if found is None:
            order.append(p)
        else:
            if found[0] not in sets:
                order.append(found[0])
            sets.setdefault(found[0], []).append(found[1])
    return [predicate_of(x[0], combine(sets[x])) if isinstance(x, tuple) else x for x in order]


def conjuncts(p: Predicate) -> tuple[Predicate, ...]:
    return p.items if isinstance(p, And) else () if p == TRUE else (p,)


def disjuncts(p: Predicate) -> tuple[Predicate, ...]:
    return p.items if isinstance(p, Or) else (p,)


def _and(items: Iterable[Predicate]) -> Predicate:
    flat = [x for x in _flat(And, items) if x != TRUE]
    flat = [x for x in _flat(And, _merge_values(flat, intersect)) if x != TRUE]
    if FALSE in flat or any(Not(x) in flat for x in flat):
        return FALSE
    bounded = {x.left for x in flat if isinstance(x, Comparison) and not (isinstance(x.right, Literal) and x.right.value is None)}
    flat = [x for x in flat if not (isinstance(x, NotNull) and x.operand in bounded)]
    flat = [x for x in flat if not (isinstance(x, Or) and any(set(conjuncts(d)) <= set(flat) - {x} for d in x.items))]
    return TRUE if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def _merge_members(items: list[Predicate]) -> list[Predicate]:
    """array-contains of one array by different literals is array-contains-any."""
    found: dict[Expression, list[Expression]] = {}
    for p in items:
        if isinstance(p, Comparison) and (p.op == "array-contains" or (p.op == "array-contains-any" and isinstance(p.right, tuple))):
            values = p.right if isinstance(p.right, tuple) else (p.right,)
            if all(isinstance(v, Literal) and v.value is not None for v in values):
                found.setdefault(p.left, []).extend(values)
    out: list[Predicate] = []
    for p in items:
        if isinstance(p, Comparison) and p.op in ("array-contains", "array-contains-any") and p.left in found:
            values = tuple(dict.fromkeys(found[p.left]))
            mine = p.right if isinstance(p.right, tuple) else (p.right,)
            if set(mine) <= set(values):
                p = Comparison("array-contains", p.left, values[0]) if len(values) == 1 else Comparison("array-contains-any", p.left, values)
        if p not in out:
            out.append(p)
    return out


def _or(items: Iterable[Predicate]) -> Predicate:
    flat = [x for x in _flat(Or, items) if x != FALSE]
    flat = _merge_members([x for x in _flat(Or, _merge_values(flat, unite)) if x != FALSE])
    if TRUE in flat:
        return TRUE
    whole = {x.operand for x in flat if isinstance(x, NotNull)}
    flat = [x for x in flat if not (isinstance(x, Comparison) and x.left in whole and not (isinstance(x.right, Literal) and x.right.value is None))]
    sets = [frozenset(conjuncts(x)) for x in flat]
    flat = [x for i, x in enumerate(flat) if not any(sets[j] < sets[i] for j in range(len(flat)))]
    if not flat:
        return FALSE
    if len(flat) == 1:
        return flat[0]
    shared = [c for c in conjuncts(flat[0]) if all(c in conjuncts(x) for x in flat[1:])]
    if shared:
        return _and([*shared, _or([_and([c for c in conjuncts(x) if c not in shared]) for x in flat])])
    # disjuncts that differ in the values of one field
    seen: dict[tuple, int] = {}
    for i, x in enumerate(flat):
        parts = conjuncts(x)
        for c in parts if len(parts) > 1 else ():
            found = values_of(c)
            if found:
                key = frozenset(p for p in parts if p != c), found[0]
                if key in seen:
                    j = seen[key]
                    other = next(values_of(p)[1] for p in conjuncts(flat[j]) if p not in key[0])
                    merged = _and([*[p for p in parts if p != c], predicate_of(found[0][0], unite([found[1], other]))])
                    return _or([merged if k == j else y for k, y in enumerate(flat) if k != i])
                seen[key] = i
    return Or(tuple(flat))


def _simplify(p: Predicate) -> Predicate:
    if isinstance(p, And):
        return _and(_simplify(x) for x in p.items)
    if isinstance(p, Or):
        return _or(_simplify(x) for x in p.items)
    if isinstance(p, Comparison):
        folded = _fold(p)
        found = values_of(folded)
        if found:
            return predicate_of(found[0][0], found[1])
        return folded if folded == p or isinstance(folded, Comparison) else _simplify(folded)
    return p


def normalize(p: Predicate) -> Predicate:
    """A simpler predicate that selects the same rows."""
    p = push_not(p)
    for _ in range(12):
        q = _simplify(p)
        if q == p:
            break
        p = q
    return p


def constraints(p: Predicate | None) -> list[tuple[str, str]]:
    """(field, operator) of the conjuncts that compare a field with values."""
    return [(".".join(c.left.path), c.op) for c in conjuncts(p or TRUE) if isinstance(c, Comparison) and isinstance(c.left, Field) and not isinstance(c.right, Field)]

"""Rewritten predicates select the same rows, NULLs included, and have the shapes meant."""

import random

import pytest
from pyspark.sql import functions as F

from docweave import and_, array_contains, array_contains_any, compare, constant, eq, field, gt, gte, in_list, like, lt, lte, ne, not_, not_in_list, or_
from docweave.model import And, Comparison, Literal, Not, NotNull, Or
from docweave.plans.columns import Compiler
from docweave.plans.normalize import FALSE, TRUE, complement, intersect, normalize, unite

X, S, T = field("u.x"), field("u.s"), field("u.tags")
VALUES = [None, 1, 2, 3, 4, 5, 6, 7]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(x, s, t) for x in VALUES for s in (None, "a", "b") for t in (None, [], ["p"], ["p", "q"], ["r", None])]
    return spark.createDataFrame(data, "x long, s string, tags array<string>").select(F.struct("*").alias("u"))


def same(rows, pairs):
    make = Compiler(rows)
    checks = [F.max(F.coalesce(make.predicate(p), F.lit(False)) != F.coalesce(make.predicate(q), F.lit(False))).alias(f"c{i}") for i, (p, q) in enumerate(pairs)]
    wrong = [pairs[i] for i, bad in enumerate(rows.agg(*checks).first()) if bad]
    assert not wrong, wrong[0]


CASES = [
    (and_([gt(X, 5), gte(X, 5)]), gt(X, 5)),
    (and_([gte(X, 5), gt(X, 5)]), gt(X, 5)),
    (and_([gte(X, 5), lte(X, 5)]), eq(X, 5)),
    (and_([gt(X, 7), lt(X, 5)]), FALSE),
    (and_([eq(X, 7), eq(X, 5)]), FALSE),
    (and_([gt(X, 7), gt(X, 5)]), gt(X, 7)),
    (and_([ne(X, 5), gte(X, 5)]), gt(X, 5)),
    (and_([in_list(X, [1, 2, 3]), in_list(X, [2, 3, 4])]), in_list(X, [2, 3])),
    (and_([in_list(X, [1, 2]), ne(X, 1)]), eq(X, 2)),
    (and_([in_list(X, [1, 5, 7]), gt(X, 4), lt(X, 7)]), eq(X, 5)),
    (and_([ne(X, 1), ne(X, 2)]), not_in_list(X, [1, 2])),
    (and_([ne(X, 1), gt(X, 3)]), gt(X, 3)),
    (and_([eq(X, 3), not_in_list(X, [1, 2]), lt(X, 9)]), eq(X, 3)),
    (or_([eq(X, 1), eq(X, 2)]), in_list(X, [1, 2])),
    (or_([lt(X, 5), eq(X, 5)]), lte(X, 5)),
    (or_([gt(X, 5), eq(X, 5)]), gte(X, 5)),
    (or_([lt(X, 5), gt(X, 5)]), ne(X, 5)),
    (or_([ne(X, 5), eq(X, 5)]), NotNull(X)),
    (or_([ne(X, 5), gte(X, 5)]), NotNull(X)),
    (or_([ne(X, 5), gt(X, 5)]), ne(X, 5)),
    (or_([ne(X, 5), eq(X, 3)]), ne(X, 5)),
    (or_([not_in_list(X, [1, 2]), eq(X, 1)]), ne(X, 2)),
    (or_([not_in_list(X, [1, 2]), in_list(X, [1, 2])]), NotNull(X)),
    (in_list(X, []), FALSE),
    (not_in_list(X, []), TRUE),
    (array_contains_any(T, []), FALSE),
    (in_list(X, [4]), eq(X, 4)),
    (in_list(X, [4, 4, 5]), in_list(X, [4, 5])),
    (array_contains_any(T, ["p"]), array_contains(T, "p")),
    (or_([array_contains(T, "p"), array_contains(T, "q")]), array_contains_any(T, ["p", "q"])),
    (not_(not_(eq(X, 1))), eq(X, 1)),
    (not_(constant(True)), FALSE),
    (not_(or_([eq(X, 1), gt(X, 5)])), None),
    (not_(and_([in_list(X, [1, 2]), eq(S, "a")])), None),
    (or_([eq(S, "a"), and_([eq(S, "a"), gt(X, 2)])]), eq(S, "a")),
    (or_([and_([eq(S, "a"), eq(X, 1)]), and_([eq(S, "a"), eq(X, 2)])]), and_([eq(S, "a"), in_list(X, [1, 2])])),
    (and_([constant(True), and_([eq(X, 1), and_([eq(X, 1)])])]), eq(X, 1)),
    (eq(5, X), eq(X, 5)),
    (lt(5, X), gt(X, 5)),
    (eq(1, 1), TRUE),
    (in_list(2, [1, 2]), TRUE),
    (or_([in_list(X, [1, field("u.x")])]), None),
    (not_in_list(X, [1, None]), FALSE),
    (and_([like(S, "a%"), not_(like(S, "a%"))]), FALSE),
    (and_([NotNull(X), gt(X, 1)]), gt(X, 1)),
]


@pytest.mark.parametrize("given, wanted", CASES)
def test_shape(given, wanted):
    if wanted is not None:
        assert normalize(given) == wanted


def test_cases_select_the_same_rows(rows):
    same(rows, [(p, normalize(p)) for p, _ in CASES])


def _random(r, depth):
    kind = r.random()
    if depth and kind < 0.7:
        return r.choice([And, Or])(tuple(_random(r, depth - 1) for _ in range(r.randint(1, 3)))) if kind < 0.6 else Not(_random(r, depth - 1))
    v = r.randint(1, 7)
    return r.choice([
        lambda: r.choice([eq, ne, lt, lte, gt, gte])(X, v),
        lambda: r.choice([in_list, not_in_list])(X, r.sample(VALUES, r.randint(1, 3))),
        lambda: r.choice([eq, ne])(S, r.choice(["a", "b", None])),
        lambda: r.choice([lt, gte])(S, "b"),
        lambda: array_contains(T, r.choice("pqr")),
        lambda: like(S, r.choice(["a%", "_"])),
        lambda: eq(v, X),
    ])()


def test_random_predicates_select_the_same_rows(rows):
    r = random.Random(3)
    for _ in range(4):
        found = [_random(r, 3) for _ in range(60)]
        same(rows, [(p, normalize(p)) for p in found])


def test_custom_predicates_keep_their_functions(rows):
    f, g = (lambda x: x > 2), (lambda x: x > 5)
    p = or_([and_([compare(X, f), eq(X, 1)]), and_([compare(X, g), eq(X, 2)])])
    assert normalize(p) == p
    assert normalize(or_([compare(X, f), compare(X, g)])) == or_([compare(X, f), compare(X, g)])


def test_literals_keep_their_types():
    assert Literal(1) != Literal("1") and Literal(1) != Literal(True) and Literal(1) == Literal(1.0)
    assert normalize(or_([eq(X, 1), eq(X, "1")])) == or_([eq(X, 1), eq(X, "1")])


def test_sets():
    a = normalize(lt(X, 3))
    assert a == Comparison("<", X, Literal(3))
    one = (((0, 1, 0), (0, 1, 1)),)
    assert intersect([complement(one), one]) == () and complement(unite([one, complement(one)])) == ()

"""Small collections with known answers."""

import warnings

import pytest
from pyspark.sql import functions as F

import docweave as d
from docweave import and_, array_contains, array_contains_any, collection_group, eq, field, gt, gte, in_list, like, lt, lte, ne, not_, not_in_list, or_, param, projection
from docweave.operators import band_join, count_rows, union_all, union_by_path, union_distinct
from docweave.streaming import windowed_count


def f(name):
    return field(name)


@pytest.fixture
def engine(spark):
    def make(semantics="sql", strict=True, **tables):
        s = d.Session(spark, semantics=semantics, strict=strict)
        for name, (schema, rows) in tables.items():
            s.catalog.register(name.replace("__", "/"), spark.createDataFrame(rows, schema), id_col=schema.split()[0])
        return s

    return make


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


USERS = ("id long, name string, role string, active long", [(1, "Alice", "admin", 1), (2, "Bob", "user", 0), (3, "Carol", "user", 1)])
ORDERS = ("id long, user_id long, total long", [(101, 1, 50), (102, 1, 200), (103, 2, 150), (104, 3, 75)])


def test_filter_and_order(engine):
    s = engine(users=USERS)
    q = projection("q", {"u": "users"}, {"id": f("u.id"), "name": f("u.name")}, and_([eq(f("u.role"), "user"), eq(f("u.active"), 1)]), [f("u.name")])
    assert rows(s.run(q)) == [(3, "Carol")]


def test_join_with_limit(engine):
    s = engine(users=USERS, orders=ORDERS)
    q = projection("q", {"u": "users", "o": "orders"}, {"id": f("u.id"), "name": f("u.name"), "total": f("o.total")}, and_([eq(f("u.id"), f("o.user_id")), gte(f("o.total"), 100)]), [(f("o.total"), "desc")], 2, 0)
    assert [tuple(r) for r in s.run(q).collect()] == [(1, "Alice", 200), (2, "Bob", 150)]


def test_pagination(engine):
    s = engine(products=("id long, name string", [(1, "Widget"), (2, "Gadget"), (3, "Thing")]))
    q = projection("q", {"p": "products"}, {"id": f("p.id")}, in_list(f("p.id"), [2, 3]), [f("p.id")], 1, 1)
    assert rows(s.run(q)) == [(3,)]


def test_group_count(engine):
    s = engine(users=("id long, role string", [(1, "admin"), (2, "user"), (3, "user"), (4, "guest"), (5, None)]))
    q = projection("q", {"u": "users"}, group_by={"role": f("u.role")}, order_by=[f("u.role")])
    assert [tuple(r) for r in s.run(q).collect()] == [(None, 1), ("admin", 1), ("guest", 1), ("user", 2)]
    empty = projection("q", {"u": "users"}, where=eq(f("u.id"), 99), group_by={})
    assert rows(s.run(empty)) == [(0,)]


def test_group_keys_are_not_glued_together(engine):
    s = engine(t=("id long, a string, b string", [(1, "a_b", "c"), (2, "a", "b_c")]))
    assert len(rows(s.run(projection("q", {"t": "t"}, group_by={"a": f("t.a"), "b": f("t.b")})))) == 2


HASH_MERGE = ["hash", "merge", "nested-loop", "indexed-nested-loop", "auto"]


@pytest.mark.parametrize("hint", HASH_MERGE)
def test_equi_join_with_duplicates_and_nulls(engine, hint):
    s = engine(users=("k long, id long, val string", [(1, 1, "a"), (2, 2, "b"), (3, 1, "c"), (4, None, "n")]), orders=("k long, uid long, other string", [(1, 1, "x"), (2, 3, "y"), (3, 1, "z"), (4, None, "m")]))
    q = projection("q", {"u": "users", "o": "orders"}, {"v": f("u.val"), "o": f("o.other")}, eq(f("u.id"), f("o.uid")), hints={"join": hint})
    assert rows(s.run(q)) == [("a", "x"), ("a", "z"), ("c", "x"), ("c", "z")]


@pytest.mark.parametrize("op, left, right, n", [(lt, [1, 3, 5], [2, 4, 6], 6), (lte, [2, 4], [2, 3, 4], 4), (gt, [3, 5, 7], [2, 4, 6], 6), (gte, [3, 5], [1, 3, 5], 5), (gt, [3, 3], [2, 2], 4)])
@pytest.mark.parametrize("hint", ["merge", "auto"])
def test_range_join(engine, op, left, right, n, hint):
    s = engine(a=("k long, v long", list(enumerate(left))), b=("k long, v long", list(enumerate(right))))
    assert s.run(projection("q", {"a": "a", "b": "b"}, where=op(f("a.v"), f("b.v")), hints={"join": hint})).count() == n


MEMBER = [
    ("t", "s", lambda: array_contains(f("t.tags"), f("s.tag")), [("b", 1), ("b", 3), ("z", 4)]),
    ("s", "t", lambda: in_list(f("s.tag"), f("t.tags")), [("b", 1), ("b", 3), ("z", 4)]),
]


@pytest.mark.parametrize("first, second, where, wanted", MEMBER)
@pytest.mark.parametrize("hint", ["auto", "nested-loop", "hash"])
def test_membership_join_in_both_orders(engine, first, second, where, wanted, hint):
    s = engine(t=("id long, tags array<string>", [(1, ["a", "b", "b", None]), (2, ["x", "y"]), (3, ["b", "d"]), (4, ["z"]), (5, None), (6, [])]), s=("tag string, n long", [("b", 1), ("z", 2), ("q", 3), (None, 4)]))
    q = projection("q", {first: first, second: second}, {"tag": f("s.tag"), "id": f("t.id")}, where(), hints={"join": hint})
    assert rows(s.run(q)) == wanted
    plan = s.run(q)._jdf.queryExecution().toString()
    if hint != "nested-loop":
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hint", ["auto", "nested-loop"])
def test_overlap_join_gives_each_pair_once(engine, hint):
    s = engine(i=("id long, tags array<string>", [(1, ["a", "b", "c"]), (2, ["x"]), (3, None), (4, [None])]), o=("id long, options array<string>", [(1, ["b", "c", "c"]), (2, ["z"]), (3, [None])]))
    q = projection("q", {"i": "i", "o": "o"}, {"i": f("i.id"), "o": f("o.id")}, array_contains_any(f("i.tags"), f("o.options")), hints={"join": hint})
    assert rows(s.run(q)) == [(1, 1)]


@pytest.mark.parametrize("where", [lambda: eq(f("a.k"), f("b.k")), lambda: array_contains(f("a.tags"), f("b.tag")), lambda: array_contains_any(f("a.tags"), f("b.tags"))])
def test_nested_loop_hint_compares_no_pairs_where_there_is_a_key(engine, where):
    same = "id long, k long, tag string, tags array<string>"
    s = engine(a=(same, [(1, 7, "x", ["x", "y"]), (2, 8, "z", ["z"]), (3, None, None, None)]), b=(same, [(5, 7, "y", ["y"]), (6, 9, "q", ["q"]), (7, None, None, [None])]))
    out = s.run(projection("q", {"a": "a", "b": "b"}, {"a": f("a.id"), "b": f("b.id")}, where(), hints={"join": "nested-loop"}))
    assert rows(out) == [(1, 5)]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hint", ["auto", "hash", "merge", "nested-loop"])
def test_rows_of_a_frequent_key_are_joined_by_many_tasks(engine, spark, monkeypatch, hint):
    """Pairs come once each, whether a key is frequent on both sides, one side or none, and no task makes most of them."""
    monkeypatch.setattr("docweave.operators.joins.TOGETHER", 8)
    a = [(i, 1 if i < 200 else 2 if i < 300 else None if i < 310 else i, f"{i}") for i in range(320)]
    b = [(i, 1 if i < 90 else 3 if i < 120 else None if i < 130 else 2 if i < 132 else 180 + i, f"{i % 40}") for i in range(140)]
    s = engine(a=("id long, k long, t string", a), b=("id long, k int, t string", b))
    ask = lambda where: s.run(projection("q", {"a": "a", "b": "b"}, {"a": f("a.id"), "b": f("b.id")}, where, hints={"join": hint}))
    want = sorted((i, j) for i, k, _ in a for j, m, _ in b if k is not None and k == m)
    out = ask(eq(f("a.k"), f("b.k")))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 200 * 90
    made = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) > 8 and max(made) < len(want) / 2
    # keys of two parts, text against numbers, and a condition beside the key
    two = ask(and_([eq(f("a.k"), f("b.k")), eq(f("a.t"), f("b.t"))]))
    assert sorted(map(tuple, two.collect())) == sorted((i, j) for i, k, t in a for j, m, u in b if k is not None and k == m and t == u)
    assert sorted(map(tuple, ask(eq(f("a.k"), f("b.t"))).collect())) == sorted((i, j) for i, k, _ in a for j, _, u in b if k is not None and k == int(u))
    less = ask(and_([eq(f("b.k"), f("a.k")), lt(f("a.id"), f("b.id"))]))
    assert sorted(map(tuple, less.collect())) == [p for p in want if p[0] < p[1]]


def test_a_key_that_is_an_identity_is_joined_as_before(engine):
    s = engine(a=("id long, k long", [(1, 5), (2, 5)]), b=("id long, k long", [(5, 1), (6, 5)]))
    for key in (f("b.id"), f("b.#id"), f("b.#path")):
        out = s.run(projection("q", {"a": "a", "b": "b"}, {"a": f("a.id"), "b": f("b.id")}, eq(f("a.k"), key)))
        assert "explode" not in out._jdf.queryExecution().toString()


def test_loose_equality_reads_numbers_in_text(engine):
    s = engine(u=("id string, n long", [("1", 5), ("abc", 6), (None, 7)]), o=("k long, uid long", [(1, 1), (2, 2)]))
    assert rows(s.run(projection("q", {"u": "u", "o": "o"}, {"n": f("u.n")}, eq(f("u.#id"), f("o.uid"))))) == [(5,)]
    b = engine(b=("id long, ok boolean", [(1, True)]))
    with pytest.raises(TypeError):
        b.run(projection("q", {"b": "b"}, where=eq(f("b.ok"), 1)))


def test_null_semantics(engine):
    table = ("id long, v long", [(1, 5), (2, 6), (3, None)])
    sql, two = engine(t=table), engine(semantics="two_valued", t=table)
    get = lambda s, p: [i for (i,) in rows(s.run(projection("q", {"t": "t"}, {"id": f("t.id")}, p)))]
    assert get(sql, ne(f("t.v"), 5)) == [2] and get(two, ne(f("t.v"), 5)) == [2, 3]
    assert get(sql, not_(eq(f("t.v"), 5))) == [2] and get(two, not_(eq(f("t.v"), 5))) == [2, 3]
    assert get(sql, eq(f("t.v"), None)) == [3] and get(sql, ne(f("t.v"), None)) == [1, 2]
    assert get(sql, not_in_list(f("t.v"), [5, None])) == []
    assert get(sql, and_([])) == [1, 2, 3] and get(sql, or_([])) == []


@pytest.mark.parametrize("pattern, hit", [("Ali%", True), ("%ice", True), ("%li%", True), ("A_i%", True), ("", False), ("Alice.+", False), ("alice", False), ("Alice", True)])
def test_like(engine, pattern, hit):
    s = engine(u=("id long, name string", [(1, "Alice"), (2, None)]))
    for p in (pattern, param("p")):
        assert s.run(projection("q", {"u": "u"}, where=like(f("u.name"), p)), {"p": pattern}).count() == int(hit)


def test_like_with_backslash_and_newline(engine):
    s = engine(u=("id long, name string", [(1, "a\\b\nc%")]))
    for pattern, n in (("a\\b%", 1), ("a%c_", 1), ("%\\", 0), ("a\\%", 1)):
        assert s.run(projection("q", {"u": "u"}, where=like(f("u.name"), pattern))).count() == n


def test_params_and_prepared_plans(engine):
    s = engine(users=USERS)
    plan = s.prepare(projection("q", {"u": "users"}, {"name": f("u.name")}, eq(f("u.id"), param("userId"))))
    assert rows(plan.bind({"userId": 1})) == [("Alice",)] and rows(plan.bind({"userId": 2})) == [("Bob",)]
    with pytest.raises(KeyError, match='Parameter "userId" was not provided.'):
        plan.bind()
    assert rows(s.run(projection("q", {"u": "users"}, {"n": f("u.name")}, in_list(f("u.id"), [1, param("p")])), {"p": 3})) == [("Alice",), ("Carol",)]


def test_function_of_a_parameter_is_pushed_to_the_scan(engine, spark, tmp_path):
    spark.createDataFrame([(1, "A-x"), (2, "B-x")], "id long, code string").write.parquet(str(tmp_path / "t"))
    s = d.Session(spark)
    s.catalog.read("t", str(tmp_path / "t"), id_col="id")
    out = s.run(projection("q", {"t": "t"}, {"id": f("t.id")}, eq(f("t.code"), d.apply([param("p"), "x"], lambda x: "-".join(x), "string"))), {"p": "B"})
    plan = out._jdf.queryExecution().toString()
    assert rows(out) == [(2,)] and "EqualTo(code,B-x)" in plan and "ReadSchema: struct<id:bigint,code:string>" in plan


def test_in_list_with_fields(engine):
    s = engine(u=("id long, x long", [(1, 1), (2, 2), (3, 3)]), c=("id long, x long", [(1, 2)]))
    assert rows(s.run(projection("q", {"u": "u", "c": "c"}, {"x": f("u.x")}, in_list(f("u.x"), [1, param("p"), f("c.x")])), {"p": 4})) == [(1,), (2,)]


def test_tags(engine):
    s = engine(p=("color string, tags array<string>", [("red", ["warm", "primary"]), ("blue", ["cool", "primary"]), ("green", ["cool", "neutral"])]))
    get = lambda p: rows(s.run(projection("q", {"p": "p"}, {"c": f("p.color")}, p)))
    assert get(and_([not_in_list(f("p.color"), ["red", "green"]), array_contains_any(f("p.tags"), ["primary", "neutral"])])) == [("blue",)]
    assert get(array_contains(f("p.tags"), "warm")) == [("red",)] and get(array_contains(f("p.tags"), 1)) == []


def test_flattening_paths(engine):
    schema = "id long, d struct<price: long>, tags array<struct<name: string, g: array<struct<h: long>>>>, m map<string, long>"
    s = engine(p=(schema, [(1, (100,), [("sale", [(1,), (None,)]), (None, None), ("new", [(2,)])], {"k": 7}), (2, None, [], None)]))
    q = projection("q", {"p": "p"}, {"id": f("p.id"), "price": f("p.d.price"), "names": f("p.tags.name"), "deep": f("p.tags.g.h"), "k": f("p.m.k")})
    assert rows(s.run(q)) == [(1, 100, ["sale", "new"], [1, 2], 7), (2, None, None, None, None)]
    with pytest.raises(ValueError, match="No field"):
        s.run(projection("q", {"p": "p"}, {"x": f("p.nope")}))
    loose = engine(strict=False, p=("id long", [(1,)]))
    assert rows(loose.run(projection("q", {"p": "p"}, {"x": f("p.nope")}))) == [(None,)]


def test_functions(engine):
    s = engine(t=("id long, s string, x double, n long", [(1, "Ab", 2.0, 3), (2, None, 0.0, None)]))
    q = projection("q", {"t": "t"}, {"id": f("t.id"), "c": d.concatenate([f("t.s"), "-", f("t.x"), f("t.n")]), "l": d.lowercase(f("t.s")), "u": d.uppercase(f("t.s")), "a": d.add(f("t.n"), 1), "as": d.add(f("t.s"), f("t.x")), "q": d.divide(f("t.n"), f("t.x")), "m": d.multiply(d.subtract(f("t.n"), 1), 2)})
    assert rows(s.run(q)) == [(1, "Ab-23", "ab", "AB", 4, "Ab2", 1.5, 4), (2, "-0", None, None, None, None, None, None)]


def test_python_functions_keep_the_shape_of_their_inputs(engine):
    s = engine(j=("id long, title string", [(1, "Engineer")]))
    shout = d.apply([[f("j.title"), "!"], param("p")], lambda x: f"{x[0][0]} {x[0][1]}{x[1]}", "string")
    assert rows(s.run(projection("q", {"j": "j"}, {"s": shout}), {"p": "?"})) == [("Engineer !?",)]
    assert s.run(projection("q", {"j": "j"}, where=d.compare([f("j.title")], lambda x: x[0] == "Engineer", python=True))).count() == 1


def test_metadata_and_nested_collections(engine, spark):
    s = d.Session(spark)
    s.catalog.register("users", spark.createDataFrame([("user1", "Alice"), ("user2", "Bob")], "id string, name string"), id_col="id")
    s.catalog.register("users/orders", spark.createDataFrame([("users/user1/orders/order1", "Book"), ("users/user2/orders/order2", "Pen")], "at string, item string"), path_col="at")
    s.catalog.register("shops/s1/orders", spark.createDataFrame([("o9", "Cup")], "id string, item string"), id_col="id")
    meta = {"id": f("o.#id"), "path": f("o.#path"), "c": f("o.#collection"), "pid": f("o.#parent.#id"), "pp": f("o.#parent.#path"), "none": f("o.#parent.#parent.#id")}
    assert rows(s.run(projection("q", {"o": "users/user1/orders"}, meta))) == [("order1", "users/user1/orders/order1", "orders", "user1", "users/user1", None)]
    assert rows(s.run(projection("q", {"u": "users"}, {"p": f("u.#parent"), "i": f("u.#parent.#id")}))) == [(None, None), (None, None)]
    assert rows(s.run(projection("q", {"o": collection_group("orders")}, {"i": f("o.item")}))) == [("Book",), ("Cup",), ("Pen",)]
    q = projection("q", {"u": "users", "o": "users/{u.#id}/orders"}, {"n": f("u.name"), "i": f("o.item")})
    assert rows(s.run(q)) == [("Alice", "Book"), ("Bob", "Pen")]
    with pytest.raises(ValueError, match="Unknown metadata"):
        s.run(projection("q", {"u": "users"}, {"x": f("u.#what")}))
    with pytest.raises(KeyError):
        s.run(projection("q", {"u": "nowhere"}))


def test_cross_product_warns(engine):
    s = engine(a=("id long", [(1,), (2,)]), b=("id long", [(1,), (2,), (3,)]))
    with pytest.warns(UserWarning, match="every pair"):
        assert s.run(projection("q", {"a": "a", "b": "b"})).count() == 6


def test_join_order_avoids_cross_products(engine):
    s = engine(n=("id long", [(1,)]), o=("id long, c long", [(1, 1)]), c=("id long, n long", [(1, 1)]))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert s.run(projection("q", {"n": "n", "o": "o", "c": "c"}, where=and_([eq(f("c.n"), f("n.id")), eq(f("o.c"), f("c.id"))]))).count() == 1


@pytest.mark.parametrize("mode", [{"predicate_or_mode": "union"}, {"predicate_or_mode": "single-scan"}, {"predicate_mode": "respect"}, {}])
def test_or_modes(engine, mode):
    s = engine(t=("id long, a long, b long", [(1, 1, None), (2, 1, 2), (3, None, 2), (4, 0, 0), (2, 1, 2)]))
    q = projection("q", {"t": "t"}, {"id": f("t.id")}, or_([eq(f("t.a"), 1), eq(f("t.b"), 2)]), hints=mode)
    assert rows(s.run(q)) == [(1,), (2,), (2,), (3,)]


def test_unions(engine):
    s = engine(u=("id long, v long", [(1, 5), (2, 5), (3, 6)]))
    a, b = s.run(projection("q", {"x": "u"}, where=lt(f("x.v"), 6))), s.run(projection("q", {"x": "u"}, where=gt(f("x.id"), 1)))
    other = s.run(projection("q", {"y": "u"}))
    assert union_all(a, b).count() == 4 and union_by_path(a, b).count() == 3
    assert union_distinct(a, b).count() == 3 and union_distinct(a, other).count() == 5
    assert rows(count_rows(union_all(a, b), {"v": F.col("x.v")})) == [(5, 3), (6, 1)]


def test_band_join(spark):
    p, b = spark.createDataFrame([(1, 0.0), (2, 9.9), (3, 10.0), (4, -5.0), (5, None)], "i long, x double"), spark.createDataFrame([(1, -6.0, 0.0), (2, 9.0, 31.0), (3, 5.0, 4.0)], "j long, lo double, hi double")
    assert rows(band_join(p, F.col("x"), b, F.col("lo"), F.col("hi"), 7.0).select("i", "j")) == [(1, 1), (2, 2), (3, 2), (4, 1)]


def test_hint_errors(engine):
    s = engine(a=("id long", [(1,)]), b=("id long", [(1,)]))
    for hint, p, text in (("hash", lt(f("a.id"), f("b.id")), "Hash join hint"), ("merge", ne(f("a.id"), f("b.id")), "Merge join hint"), ("indexed-nested-loop", d.compare([f("a.id"), f("b.id")], lambda x: x[0] == x[1]), "Indexed nested-loop")):
        with pytest.raises(ValueError, match=text):
            s.run(projection("q", {"a": "a", "b": "b"}, where=p, hints={"join": hint}))


def test_validation():
    with pytest.raises(ValueError, match="at least one source"):
        projection("q", {})
    with pytest.raises(ValueError, match="unknown alias"):
        projection("q", {"a": "a"}, {"x": f("b.x")})
    with pytest.raises(ValueError):
        field("alone")
    with pytest.raises(TypeError):
        field(3)
    with pytest.raises(TypeError):
        d.literal([1])
    with pytest.raises(TypeError, match="right operand to be an array"):
        in_list(f("a.x"), 3)
    for bad in ({"hints": {"join": "magic"}}, {"hints": {"nope": "x"}}, {"limit": -1}, {"order_by": [(f("a.x"), "up")]}):
        with pytest.raises(ValueError):
            projection("q", {"a": "a"}, **bad)


def test_limits_of_a_document_store_are_optional(engine):
    s = engine(t=("id long, a long, b long", [(1, 1, 1)]))
    q = projection("q", {"t": "t"}, where=and_([gt(f("t.a"), 0), lt(f("t.b"), 5)]))
    assert s.run(q).count() == 1
    with pytest.raises(ValueError, match="several fields"):
        s.check_limits(q)
    with pytest.raises(ValueError, match="first order"):
        s.check_limits(projection("q", {"t": "t"}, where=gt(f("t.a"), 0), order_by=[f("t.b")]))


def test_sort_unique_materialize(engine, tmp_path):
    s = engine(t=("id long, v long", [(1, 20), (2, None), (3, 10), (4, 20)]))
    q = projection("q", {"t": "t"}, {"id": f("t.id")}, order_by=[(d.multiply(f("t.v"), param("way")), "asc"), f("t.id")])
    assert [i for (i,) in s.run(q, {"way": -1}).collect()] == [2, 1, 4, 3] and [i for (i,) in s.run(q, {"way": 1}).collect()] == [2, 3, 1, 4]
    assert rows(s.run(projection("q", {"t": "t"}, {"v": f("t.v")}, unique_by=["v"], order_by=[f("t.v")]))) == [(10,), (20,), (None,)]
    out = s.run(projection("q", {"t": "t"}, {"id": f("t.id")}, materialize_to=str(tmp_path / "out")))
    assert out.count() == 4 and list((tmp_path / "out").glob("*.parquet"))


def test_explain_and_indexes(engine):
    s = engine(users=USERS)
    s.indexes.load('{"indexes": [{"collectionGroup": "users", "queryScope": "COLLECTION", "fields": [{"fieldPath": "role", "order": "ASCENDING"}, {"fieldPath": "id", "order": "DESCENDING"}]}]}')
    text = s.explain(projection("q", {"u": "users"}, where=eq(f("u.role"), "user"), order_by=[(f("u.id"), "desc")]))
    assert "index exact, cost 1" in text and "Physical Plan" in text
    match = s.indexes.match
    assert match("users", [("role", "=="), ("id", ">")]).type == "exact"
    assert match("users", [("role", "=="), ("name", "==")]).type == "partial"
    assert match("users", [("name", "==")]).type == "none" and match("x", []).type == "none"
    assert match("users", [("role", "==")], ("id", "asc")).type == "partial"


def test_stream_runs_through_a_projection(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:05:00"), (2, "b", "2024-01-01 00:50:00"), (3, "a", "2024-01-01 01:10:00")], "id long, k string, at string").selectExpr("id", "k", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, at timestamp").parquet(str(tmp_path / "in"))
    s = d.Session(spark)
    s.catalog.register("events", stream, id_col="id")
    s.catalog.register("names", spark.createDataFrame([("a", "first")], "k string, name string"), id_col="k")
    q = projection("q", {"e": "events", "n": "names"}, {"id": f("e.id"), "name": f("n.name")}, and_([eq(f("e.k"), f("n.k")), gt(f("e.id"), 1)]))
    out = s.run(q)
    assert out.isStreaming
    out.writeStream.format("memory").queryName("joined").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination(60)
    assert rows(spark.table("joined")) == [(3, "first")]
    counted = windowed_count(stream, "at", "1 hour", "5 minutes", ["k"])
    counted.writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(60)
    assert sorted(r["count"] for r in spark.table("counted").collect()) == [1, 1, 1]


def test_cli(tmp_path, capsys, monkeypatch):
    from docweave.cli import main

    (tmp_path / "functions").mkdir()
    (tmp_path / "functions" / "indexes.json").write_text('{"indexes": [{"collectionGroup": "a", "fields": []}]}')
    (tmp_path / "deep").mkdir()
    monkeypatch.chdir(tmp_path / "deep")
    assert main(["generate", "--output-dir", "out"]) == 0
    made = capsys.readouterr().out.strip()
    scope: dict = {}
    exec(open(made).read(), scope)
    assert scope["INDEXES"]["indexes"][0]["collectionGroup"] == "a"
    assert main(["generate", "--indexes-json", "missing.json"]) == 1

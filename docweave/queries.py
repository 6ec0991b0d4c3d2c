"""The registered queries over the test tables, and the SQL that each equals."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model as m
from .cli import module_text
from .functions import add, apply, concatenate, divide, lowercase, multiply, subtract, uppercase
from .model import Projection, and_, array_contains, array_contains_any, collection_group, compare, constant, eq, field, gt, gte, in_list, like, lt, lte, ne, not_, not_in_list, or_, param, projection
from .operators import band_join, count_rows, union_all, union_by_path, union_distinct
from .session import Session
from .sources import PATH, Catalog, Indexes
from .streaming import windowed_count

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}


def session(spark: SparkSession, sf_dir: str, **options: Any) -> Session:
    """A session whose catalog has the test tables, and a few shaped from them."""
    catalog = Catalog(spark)
    for name, key in IDS.items():
        catalog.read(name, f"{sf_dir}/{name}.parquet", id_col=key)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.split("p_name", " ")
    catalog.register("tagged", part.select("p_partkey", words.alias("tags"), F.struct(F.col("p_retailprice").alias("value"), F.col("p_brand").alias("brand")).alias("price"), F.transform(words, lambda w: F.struct(w.alias("name"), F.length(w).alias("size"))).alias("marks")), "p_partkey")
    catalog.register("keyword", part.select(F.explode(words).alias("word")).distinct(), "word")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    catalog.register("wish", nation.select("n_nationkey", F.array(F.element_at(F.split(F.lower("n_name"), " "), 1), F.when(F.col("n_nationkey") % 2 == 0, "red").otherwise("blue"), F.lit("widget")).alias("options")), "n_nationkey")
    catalog.register("gappy", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal"), "c_custkey")
    # nations as documents below their regions
    catalog.register("region/nations", nation.withColumn("at", F.concat(F.lit("region/"), "n_regionkey", F.lit("/nations/"), "n_nationkey")), path_col="at")
    catalog.register("archive/0/nations", nation.where("n_nationkey < 5").select("n_nationkey", "n_name"), "n_nationkey")
    # an open JSON object for each event
    catalog.register("json_event", spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.parse_json("props").alias("props")), "event_id")
    return Session(spark, catalog, **options)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, query: Projection | Callable[[], Projection], params: dict[str, Any] | None = None, then: Callable[[DataFrame], DataFrame] | None = None, **options: Any) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out = session(spark, sf_dir, **options).run(query() if callable(query) else query, params)
        return then(out) if then else out

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _own(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


def f(name: str) -> m.Field:
    return field(name)


def pick(*names: str) -> dict[str, m.Field]:
    """Each field under the name of its last step."""
    return {n.split(".")[-1]: field(n) for n in names}


CUSTOMER_ORDERS = {"c": "customer", "o": "orders"}
_add(
    "top_orders",
    "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    projection("top_orders", CUSTOMER_ORDERS, pick("c.c_name", "o.o_orderkey", "o.o_totalprice"), and_([eq(f("c.c_custkey"), f("o.o_custkey")), gte(f("o.o_totalprice"), 100000)]), [(f("o.o_totalprice"), "desc"), f("o.o_orderkey")], 20, 5),
)
_add("scan_project", "SELECT n_nationkey AS id, n_name AS name FROM nation", projection("scan_project", {"n": "nation"}, {"id": f("n.n_nationkey"), "name": f("n.n_name")}))
_add("scan_all", "SELECT r_regionkey, r_name FROM region", projection("scan_all", {"r": "region"}), then=lambda d: d.select("r.r_regionkey", "r.r_name"))
_add(
    "filter_cmp",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 AND o_totalprice <= 200000 AND o_orderkey >= 10 AND o_custkey < 1000000 AND o_orderpriority <> '5-LOW'",
    projection("filter_cmp", {"o": "orders"}, pick("o.o_orderkey", "o.o_totalprice"), and_([eq(f("o.o_orderstatus"), "F"), gt(f("o.o_totalprice"), 50000), lte(f("o.o_totalprice"), 200000), gte(f("o.o_orderkey"), 10), lt(f("o.o_custkey"), 1000000), ne(f("o.o_orderpriority"), "5-LOW")])),
)
_add(
    "filter_or_not",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity < 20)",
    projection("filter_or_not", {"l": "lineitem"}, pick("l.l_orderkey", "l.l_linenumber", "l.l_quantity"), not_(or_([eq(f("l.l_returnflag"), "R"), lt(f("l.l_quantity"), 20)]))),
)
_add("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", projection("filter_in", {"o": "orders"}, pick("o.o_orderkey"), in_list(f("o.o_orderpriority"), ["1-URGENT", "2-HIGH"])))
#: A list longer than what a document store takes at once.
_SIZES = [*range(1, 12), *range(15, 30), *range(33, 48)]
_add("filter_in_long", f"SELECT p_partkey, p_name FROM part WHERE p_size IN ({', '.join(map(str, _SIZES))})", projection("filter_in_long", {"p": "part"}, pick("p.p_partkey", "p.p_name"), in_list(f("p.p_size"), _SIZES)))
_add("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", projection("filter_not_in", {"o": "orders"}, pick("o.o_orderkey"), not_in_list(f("o.o_orderpriority"), ["1-URGENT", "2-HIGH"])))
_GAPPY = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer)"
_add("filter_null", f"SELECT c_custkey FROM {_GAPPY} WHERE segment IS NULL", projection("filter_null", {"g": "gappy"}, pick("g.c_custkey"), eq(f("g.segment"), None)))
_add("filter_not_null", f"SELECT c_custkey, segment FROM {_GAPPY} WHERE segment IS NOT NULL AND segment <> 'MACHINERY'", projection("filter_not_null", {"g": "gappy"}, pick("g.c_custkey", "g.segment"), and_([ne(f("g.segment"), None), ne(f("g.segment"), "MACHINERY")])))
_add("filter_two_valued", f"SELECT c_custkey FROM {_GAPPY} WHERE NOT coalesce(segment = 'MACHINERY', FALSE)", projection("filter_two_valued", {"g": "gappy"}, pick("g.c_custkey"), not_(eq(f("g.segment"), "MACHINERY"))), semantics="two_valued")
_add("filter_constant", "SELECT r_name FROM region WHERE TRUE", projection("filter_constant", {"r": "region"}, pick("r.r_name"), and_([constant(True), or_([constant(False), constant(True)])])))
_add("filter_false", "SELECT r_name FROM region WHERE FALSE", projection("filter_false", {"r": "region"}, pick("r.r_name"), and_([gt(f("r.r_regionkey"), 7), lt(f("r.r_regionkey"), 5)])))
_add("filter_bounds", "SELECT o_orderkey FROM orders WHERE o_totalprice > 5000 AND o_totalprice >= 5000 AND o_totalprice <> 9000 AND o_totalprice < 400000 AND o_totalprice <> 400000", projection("filter_bounds", {"o": "orders"}, pick("o.o_orderkey"), and_([gt(f("o.o_totalprice"), 5000), gte(f("o.o_totalprice"), 5000), ne(f("o.o_totalprice"), 9000), lt(f("o.o_totalprice"), 400000), ne(f("o.o_totalprice"), 400000)])))
_add("loose_equality", "SELECT c_custkey FROM customer WHERE try_cast(right(c_name, 4) AS DOUBLE) = 42 OR c_custkey = 43", projection("loose_equality", {"c": "customer"}, pick("c.c_custkey"), or_([eq(apply(f("c.c_name"), lambda x: F.right(x, F.lit(4))), 42), eq("43", f("c.c_custkey"))])))
_add("like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'", projection("like_prefix", {"p": "part"}, pick("p.p_partkey", "p.p_name"), like(f("p.p_name"), "red%")))
_add("like_suffix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%L' OR p_type LIKE '%E%'", projection("like_suffix", {"p": "part"}, pick("p.p_partkey", "p.p_type"), or_([like(f("p.p_type"), "%L"), like(f("p.p_type"), "%E%")])))
_add("like_underscore", "SELECT c_custkey FROM customer WHERE c_name LIKE 'C_stomer%1_'", projection("like_underscore", {"c": "customer"}, pick("c.c_custkey"), like(f("c.c_name"), "C_stomer%1_")))
_add("like_param", "SELECT p_partkey FROM part WHERE p_name LIKE '%widget'", projection("like_param", {"p": "part"}, pick("p.p_partkey"), like(f("p.p_name"), param("pattern"))), {"pattern": "%widget"})
_TAGS = "(SELECT p_partkey, string_split(p_name, ' ') AS tags, p_retailprice, p_brand FROM part)"
_add("array_contains", f"SELECT p_partkey FROM {_TAGS} WHERE list_contains(tags, 'red')", projection("array_contains", {"t": "tagged"}, pick("t.p_partkey"), array_contains(f("t.tags"), "red")))
_add("array_contains_any", f"SELECT p_partkey FROM {_TAGS} WHERE list_has_any(tags, ['red', 'widget'])", projection("array_contains_any", {"t": "tagged"}, pick("t.p_partkey"), or_([array_contains(f("t.tags"), "red"), array_contains_any(f("t.tags"), ["widget", None])])))
_add("in_array_field", f"SELECT p_partkey FROM {_TAGS} WHERE list_contains(tags, 'blue')", projection("in_array_field", {"t": "tagged"}, pick("t.p_partkey"), in_list("blue", f("t.tags"))))
_add("nested_fields", f"SELECT p_partkey, p_retailprice AS value, p_brand AS brand FROM {_TAGS} WHERE p_retailprice > 950", projection("nested_fields", {"t": "tagged"}, pick("t.p_partkey", "t.price.value", "t.price.brand"), gt(f("t.price.value"), 950)))
_add("flatten_path", f"SELECT p_partkey, array_to_string(tags, '|') AS names FROM {_TAGS}", projection("flatten_path", {"t": "tagged"}, {"p_partkey": f("t.p_partkey"), "names": apply(f("t.marks.name"), lambda x: F.array_join(x, "|"))}))
_add("json_path", "SELECT event_id, props->>'$.k' AS k FROM events WHERE try_cast(props->>'$.k' AS DOUBLE) >= 50", projection("json_path", {"e": "json_event"}, {"event_id": f("e.event_id"), "k": f("e.props.k")}, gte(f("e.props.k"), 50)))

_JOIN = "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000"


def _customer_orders(hint: str) -> Projection:
    return projection(f"join_{hint}", CUSTOMER_ORDERS, pick("c.c_custkey", "o.o_orderkey"), and_([eq(f("c.c_custkey"), f("o.o_custkey")), gt(f("o.o_totalprice"), 300000)]), hints={"join": hint})


for _hint, _name in (("hash", "join_hash"), ("merge", "join_merge"), ("nested-loop", "join_nl"), ("indexed-nested-loop", "join_indexed"), ("auto", "join_auto")):
    _add(_name, _JOIN, _customer_orders(_hint))
_add("join_range", "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey < s_suppkey", projection("join_range", {"n": "nation", "s": "supplier"}, pick("n.n_nationkey", "s.s_suppkey"), lt(f("n.n_nationkey"), f("s.s_suppkey"))))
_add("join_range_merge", "SELECT a.n_nationkey, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_nationkey >= b.n_nationkey", projection("join_range_merge", {"a": "nation", "b": "nation"}, {"n_nationkey": f("a.n_nationkey"), "other": f("b.n_nationkey")}, gte(f("a.n_nationkey"), f("b.n_nationkey")), hints={"join": "merge"}))
_add("join_not_equal", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey <> r_regionkey", projection("join_not_equal", {"n": "nation", "r": "region"}, pick("n.n_name", "r.r_name"), ne(f("n.n_regionkey"), f("r.r_regionkey"))))
_WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"
_add("join_in", f"SELECT p_partkey, word FROM {_WORDS} JOIN {_TAGS} ON list_contains(tags, word)", projection("join_in", {"k": "keyword", "t": "tagged"}, pick("t.p_partkey", "k.word"), in_list(f("k.word"), f("t.tags"))))
_add("join_array_contains", f"SELECT p_partkey, word FROM {_TAGS} JOIN {_WORDS} ON list_contains(tags, word) WHERE word < 'n'", projection("join_array_contains", {"t": "tagged", "k": "keyword"}, pick("t.p_partkey", "k.word"), and_([array_contains(f("t.tags"), f("k.word")), lt(f("k.word"), "n")])))
_WISH = "(SELECT n_nationkey, [string_split(lower(n_name), ' ')[1], CASE WHEN n_nationkey % 2 = 0 THEN 'red' ELSE 'blue' END, 'widget'] AS options FROM nation)"
_add("join_array_any", f"SELECT p_partkey, n_nationkey FROM {_TAGS} JOIN {_WISH} ON list_has_any(tags, options)", projection("join_array_any", {"t": "tagged", "w": "wish"}, pick("t.p_partkey", "w.n_nationkey"), array_contains_any(f("t.tags"), f("w.options"))))
_add("join_not_in", f"SELECT p_partkey, n_nationkey FROM {_TAGS} JOIN {_WISH} ON NOT list_contains(options, tags[1])", projection("join_not_in", {"t": "tagged", "w": "wish"}, pick("t.p_partkey", "w.n_nationkey"), not_in_list(apply(f("t.tags"), lambda x: F.get(x, F.lit(0))), f("w.options"))))
_add("join_nested_key", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_brand = 'Brand#' || (s_suppkey % 30)", projection("join_nested_key", {"t": "tagged", "s": "supplier"}, pick("t.p_partkey", "s.s_suppkey"), eq(f("t.price.brand"), concatenate(["Brand#", apply(f("s.s_suppkey"), lambda x: x % 30)]))))
_add("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber AS n, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE a.l_quantity > 45", projection("join_multi_key", {"a": "lineitem", "b": "lineitem"}, {"l_orderkey": f("a.l_orderkey"), "n": f("a.l_linenumber"), "l_quantity": f("b.l_quantity")}, and_([eq(f("a.l_orderkey"), f("b.l_orderkey")), eq(f("a.l_partkey"), f("b.l_partkey")), gt(f("a.l_quantity"), 45)])))
_add(
    "join_three_way",
    "SELECT c_name, o_orderkey, l_linenumber, l_extendedprice FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment = 'AUTOMOBILE' AND l_quantity > 40",
    projection("join_three_way", {"c": "customer", "l": "lineitem", "o": "orders"}, pick("c.c_name", "o.o_orderkey", "l.l_linenumber", "l.l_extendedprice"), and_([eq(f("c.c_custkey"), f("o.o_custkey")), eq(f("o.o_orderkey"), f("l.l_orderkey")), eq(f("c.c_mktsegment"), "AUTOMOBILE"), gt(f("l.l_quantity"), 40)])),
)
_add("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey", projection("join_self", {"a": "supplier", "b": "supplier"}, {"a": f("a.s_suppkey"), "b": f("b.s_suppkey")}, and_([eq(f("a.s_nationkey"), f("b.s_nationkey")), lt(f("a.s_suppkey"), f("b.s_suppkey"))])))
_add("join_or_common", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9000 OR o_totalprice > 400000", projection("join_or_common", CUSTOMER_ORDERS, pick("c.c_custkey", "o.o_orderkey"), or_([and_([eq(f("c.c_custkey"), f("o.o_custkey")), gt(f("c.c_acctbal"), 9000)]), and_([eq(f("c.c_custkey"), f("o.o_custkey")), gt(f("o.o_totalprice"), 400000)])])))
_add("join_custom", "SELECT n_name, r_name FROM nation JOIN region ON length(n_name) % 5 = r_regionkey", projection("join_custom", {"n": "nation", "r": "region"}, pick("n.n_name", "r.r_name"), compare([f("n.n_name"), f("r.r_regionkey")], lambda x: F.length(x[0]) % 5 == x[1])))
_add("cross_join", "SELECT n_name, r_name FROM nation, region", projection("cross_join", {"n": "nation", "r": "region"}, pick("n.n_name", "r.r_name")))

_OR_SQL = "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderstatus = 'P' AND o_totalprice > 250000) OR c_acctbal < -900 OR o_orderpriority = '1-URGENT' AND o_totalprice > 350000"


def _either(mode: dict[str, str]) -> Projection:
    choice = or_([and_([eq(f("o.o_orderstatus"), "P"), gt(f("o.o_totalprice"), 250000)]), lt(f("c.c_acctbal"), -900), and_([eq(f("o.o_orderpriority"), "1-URGENT"), gt(f("o.o_totalprice"), 350000)])])
    return projection("either", {"o": "orders", "c": "customer"}, pick("o.o_orderkey", "c.c_custkey"), and_([eq(f("o.o_custkey"), f("c.c_custkey")), choice]), hints=mode)


_add("or_union", _OR_SQL, _either({"predicate_or_mode": "union"}))
_add("or_single_scan", _OR_SQL, _either({"predicate_or_mode": "single-scan"}))
_add("or_auto", _OR_SQL, _either({}))
_add("or_respect", _OR_SQL, _either({"predicate_mode": "respect"}))
_add("group_scan", "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 5", projection("group_scan", {"n": collection_group("nations")}, pick("n.n_name")))
_add("subcollection", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", projection("subcollection", {"n": "region/1/nations"}, pick("n.n_nationkey", "n.n_name")))
_add("correlated_path", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey >= 2", projection("correlated_path", {"r": "region", "n": "region/{r.#id}/nations"}, pick("r.r_name", "n.n_name"), gte(f("r.r_regionkey"), 2)))
_add("metadata", "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'region/' || n_regionkey || '/nations/' || n_nationkey AS path, 'nations' AS collection, CAST(n_regionkey AS VARCHAR) AS parent_id, 'region/' || n_regionkey AS parent FROM nation WHERE n_regionkey = 3", projection("metadata", {"n": "region/3/nations"}, {"id": f("n.#id"), "path": f("n.#path"), "collection": f("n.#collection"), "parent_id": f("n.#parent.#id"), "parent": f("n.#parent")}))
_add("join_metadata", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey", projection("join_metadata", CUSTOMER_ORDERS, pick("c.c_custkey", "o.o_orderkey"), eq(f("c.#id"), f("o.o_custkey"))))
_add("fn_string", "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, c_name || '/' || c_custkey AS both, 'n' || c_custkey AS summed FROM customer", projection("fn_string", {"c": "customer"}, {"c_custkey": f("c.c_custkey"), "low": lowercase(f("c.c_name")), "up": uppercase(f("c.c_mktsegment")), "both": concatenate([f("c.c_name"), "/", f("c.c_custkey"), None]), "summed": add("n", f("c.c_custkey"))}))
_add("fn_math", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_quantity + l_tax AS total, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem", projection("fn_math", {"l": "lineitem"}, {"l_orderkey": f("l.l_orderkey"), "l_linenumber": f("l.l_linenumber"), "revenue": multiply(f("l.l_extendedprice"), subtract(1, f("l.l_discount"))), "total": add(f("l.l_quantity"), f("l.l_tax")), "ratio": divide(f("l.l_tax"), f("l.l_discount"))}))
_add("param_query", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O', 'P')", projection("param_query", {"o": "orders"}, pick("o.o_orderkey"), and_([gt(f("o.o_totalprice"), param("least")), in_list(f("o.o_orderstatus"), ["O", param("other")])])), {"least": 200000, "other": "P"})
_add("param_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '5-LOW')", projection("param_list", {"o": "orders"}, pick("o.o_orderkey"), in_list(f("o.o_orderpriority"), param("levels"))), {"levels": ["3-MEDIUM", "5-LOW"]})
_add("udf_apply", "SELECT s_suppkey, reverse(s_name) || '!' AS told FROM supplier", projection("udf_apply", {"s": "supplier"}, {"s_suppkey": f("s.s_suppkey"), "told": apply([[f("s.s_name")], "!"], lambda x: x[0][0][::-1] + x[1], "string")}))
_add("udf_column", "SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier", projection("udf_column", {"s": "supplier"}, {"s_suppkey": f("s.s_suppkey"), "size": apply(f("s.s_acctbal"), F.abs)}))
_add("udf_compare", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3", projection("udf_compare", {"c": "customer"}, pick("c.c_custkey"), compare([f("c.c_custkey"), param("base")], lambda x: x[0] % x[1] == 3, python=True)), {"base": 7})
_add("udf_folded", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'", projection("udf_folded", {"o": "orders"}, pick("o.o_orderkey"), eq(f("o.o_orderpriority"), apply([param("level"), "HIGH"], lambda x: f"{x[0]}-{x[1]}", "string"))), {"level": 2})
_add("sort_expr", "SELECT p_partkey, p_size FROM part ORDER BY p_size * -1, p_partkey LIMIT 50", projection("sort_expr", {"p": "part"}, pick("p.p_partkey", "p.p_size"), order_by=[multiply(f("p.p_size"), param("direction")), f("p.p_partkey")], limit=50), {"direction": -1})
_add("sort_nulls", f"SELECT c_custkey, segment FROM {_GAPPY} ORDER BY segment ASC NULLS FIRST, c_custkey LIMIT 40", projection("sort_nulls", {"g": "gappy"}, pick("g.c_custkey", "g.segment"), order_by=[f("g.segment"), f("g.c_custkey")], limit=40))
_add("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30", projection("topk_offset", {"o": "orders"}, pick("o.o_orderkey", "o.o_totalprice"), order_by=[(f("o.o_totalprice"), "desc"), f("o.o_orderkey")], limit=10, offset=30))
_add("sort_hidden", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15", projection("sort_hidden", {"c": "customer"}, pick("c.c_name"), order_by=[(f("c.c_acctbal"), "desc"), f("c.c_custkey")], limit=15))
_add("group_count", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1", projection("group_count", {"o": "orders"}, group_by={"o_orderpriority": f("o.o_orderpriority")}, order_by=[f("o.o_orderpriority")]))
_add(
    "group_aggregates",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first, max(l_extendedprice) AS most, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 8) AS discount FROM lineitem GROUP BY 1, 2",
    projection("group_aggregates", {"l": "lineitem"}, group_by=pick("l.l_returnflag", "l.l_linestatus"), aggregates={"n": ("count",), "quantity": ("sum", f("l.l_quantity")), "first": ("min", f("l.l_shipdate")), "most": ("max", f("l.l_extendedprice")), "suppliers": ("count_distinct", f("l.l_suppkey")), "discount": ("avg", f("l.l_discount"))}),
    then=lambda d: d.withColumns({"quantity": F.round("quantity", 2), "discount": F.round("discount", 8)}),
)
_add("count_all", "SELECT count(*) AS count FROM lineitem", projection("count_all", {"l": "lineitem"}, group_by={}))
_add("unique_by", "SELECT DISTINCT c_mktsegment FROM customer", projection("unique_by", {"c": "customer"}, pick("c.c_mktsegment"), unique_by=["c_mktsegment"]))
_add("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation, region WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY 1", projection("revenue_by_nation", {"r": "region", "n": "nation", "c": "customer", "o": "orders", "l": "lineitem"}, where=and_([eq(f("c.c_custkey"), f("o.o_custkey")), eq(f("o.o_orderkey"), f("l.l_orderkey")), eq(f("c.c_nationkey"), f("n.n_nationkey")), eq(f("n.n_regionkey"), f("r.r_regionkey")), eq(f("r.r_name"), "ASIA")]), group_by=pick("n.n_name"), aggregates={"revenue": ("sum", multiply(f("l.l_extendedprice"), subtract(1, f("l.l_discount"))))}), then=lambda d: d.withColumn("revenue", F.round("revenue", 2)))


def _rows(spark: SparkSession, sf_dir: str, alias: str, source: str, where: m.Predicate | None = None) -> DataFrame:
    return session(spark, sf_dir).run(projection(source, {alias: source}, where=where))


@_own("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(_rows(spark, sf_dir, "x", "customer").select(F.col("x.c_nationkey").alias("k")), _rows(spark, sf_dir, "x", "supplier").select(F.col("x.s_nationkey").alias("k")))


@_own("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [_rows(spark, sf_dir, "x", t).select(F.struct(F.col(f"x.{c}").alias("k"), F.col(f"x.{PATH}")).alias("x")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return union_distinct(*sides).select("x.k")


@_own("union_by_path", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def _union_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_by_path(_rows(spark, sf_dir, "o", "orders", gt(f("o.o_totalprice"), 300000)), _rows(spark, sf_dir, "o", "orders", eq(f("o.o_orderstatus"), "P"))).select("o.o_orderkey")


@_own("band_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def _band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    return band_join(part, F.col("p_retailprice"), supplier, F.col("s_acctbal") - 5, F.col("s_acctbal") + 5, 10.0).select("p_partkey", "s_suppkey")


@_own("aggregate_count", "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY 1")
def _aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "c", "customer")
    return count_rows(rows, {"c_nationkey": F.col("c.c_nationkey")})


@_own("windowed_count", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    counted = windowed_count(events.withColumn("ts", utc), "ts", "1 hour", "10 minutes", ["event_type"])
    return counted.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast(T.TimestampNTZType())).alias("start"), "event_type", "count")


@_own("prepared_plan", "SELECT o_orderkey, 1 AS run FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_totalprice > 450000")
def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = session(spark, sf_dir).prepare(projection("prepared", {"o": "orders"}, pick("o.o_orderkey"), gt(f("o.o_totalprice"), param("least"))))
    return union_all(*(plan.bind({"least": least}).withColumn("run", F.lit(i)) for i, least in ((1, 400000), (2, 450000))))


_TOP = "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 12"


@_own("order_hint", f"SELECT hint, c_custkey, c_acctbal FROM ({_TOP}), (VALUES ('db-side'), ('post-fetch-sort'), ('auto')) AS h(hint)")
def _order_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = session(spark, sf_dir)
    make = lambda hint: projection("order_hint", {"c": "customer"}, pick("c.c_custkey", "c.c_acctbal"), gt(f("c.c_acctbal"), 0), [(f("c.c_acctbal"), "desc"), f("c.c_custkey")], 12, hints={"order_by": hint})
    return union_all(*(own.run(make(hint)).withColumn("hint", F.lit(hint)) for hint in ("db-side", "post-fetch-sort", "auto")))


@_own("session_catalog", "SELECT 'own' AS session, n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'other', n_nationkey FROM nation")
def _session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table registered anew holds for its own session only."""
    own, other = session(spark, sf_dir), session(spark, sf_dir)
    own.catalog.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1"), "n_nationkey")
    query = projection("session_catalog", {"n": "nation"}, pick("n.n_nationkey"))
    return union_all(*(s.run(query).select(F.lit(name).alias("session"), "n_nationkey") for name, s in (("own", own), ("other", other))))


INDEXES = {
    "indexes": [
        {"collectionGroup": "orders", "queryScope": "COLLECTION", "fields": [{"fieldPath": "o_orderstatus", "order": "ASCENDING"}, {"fieldPath": "o_totalprice", "order": "DESCENDING"}]},
        {"collectionGroup": "orders", "queryScope": "COLLECTION", "fields": [{"fieldPath": "o_custkey", "order": "ASCENDING"}]},
        {"collectionGroup": "tagged", "queryScope": "COLLECTION", "fields": [{"fieldPath": "tags", "arrayConfig": "CONTAINS"}]},
    ]
}


@_own(
    "index_match",
    """SELECT * FROM (VALUES ('status', 'exact', 1, 1), ('status and price', 'exact', 2, 1), ('status by price', 'exact', 2, 1), ('customer', 'exact', 1, 1), ('price', 'none', 0, 1000), ('tag', 'exact', 1, 1)) AS t("query", type, matched, cost)""",
)
def _index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scans match declared indexes, and what the planner takes them to cost."""
    own = session(spark, sf_dir)
    own.indexes.load(INDEXES)
    asked = {
        "status": ("orders", [("o_orderstatus", "==")], None),
        "status and price": ("orders", [("o_orderstatus", "=="), ("o_totalprice", ">")], None),
        "status by price": ("orders", [("o_orderstatus", "==")], ("o_totalprice", "desc")),
        "customer": ("orders", [("o_custkey", "==")], None),
        "price": ("orders", [("o_totalprice", ">")], None),
        "tag": ("tagged", [("tags", "array-contains")], None),
    }
    found = {name: own.indexes.match(*of) for name, of in asked.items()}
    return spark.createDataFrame([(name, x.type, x.matched, own.indexes.cost(x)) for name, x in found.items()], "query string, type string, matched int, cost int")


@_own("generated_indexes", "SELECT * FROM (VALUES ('orders', 'o_orderstatus', 'ASCENDING'), ('orders', 'o_totalprice', 'DESCENDING'), ('orders', 'o_custkey', 'ASCENDING'), ('tagged', 'tags', 'ARRAY_CONTAINS')) AS t(collection, field, mode)")
def _generated_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that the command line's generated module gives back."""
    scope: dict[str, Any] = {}
    exec(module_text(INDEXES), scope)  # noqa: S102
    indexes = Indexes()
    indexes.load(scope["INDEXES"])
    return spark.createDataFrame([(i.collection, name, mode) for i in indexes.definitions for name, mode in i.fields], "collection string, field string, mode string")

"""Registered queries over the library's own operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import casting
from sparkloom.functions.predicates import all_of, any_of, arithmetic, compare, differs, in_list
from sparkloom.operators import aggregates, distinct, joins, rows, sets, sorting, windows
from sparkloom.operators.aggregates import Aggregate
from sparkloom.operators.sorting import SortKey
from sparkloom.operators.windows import Window
from sparkloom.plans import sql
from sparkloom.schema import widened
from sparkloom.session import new_path
from sparkloom.sources import parquet
from sparkloom.sources.catalogue import Catalogue
from sparkloom.statistics import tables as statistics
from sparkloom.streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widened(parquet.open_table(spark, f"{sf_dir}/{name}.parquet"))


def _money(df: DataFrame, *names: str) -> DataFrame:
    """Amounts as decimals, whose sums don't depend on order."""
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields])


# projection and filters


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def filter_project(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    return rows.narrow(rows.keep(t, all_of(compare(t, "l_quantity", ">=", 45.0), compare(t, "l_returnflag", "=", "R"))), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_columns(spark, sf_dir):
    return parquet.scan(load(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    return rows.drop(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation, s_acctbal FROM supplier")
def rename_columns(spark, sf_dir):
    return rows.rename(load(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation"})


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber * 10 - 3 AS scaled, l_quantity * 2 AS twice FROM lineitem")
def compute_columns(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    made = {"scaled": arithmetic(t, arithmetic(t, "l_linenumber", "*", 10), "-", 3), "twice": arithmetic(t, "l_quantity", "*", 2)}
    return rows.project(t, ["l_orderkey", "l_linenumber", "scaled", "twice"], made)


@query("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, o_orderkey % 10 AS digit, o_custkey FROM orders")
def replace_columns(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return rows.replace(t, {"o_orderpriority": F.upper("o_orderpriority"), "digit": F.col("o_orderkey") % 10})


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000500' AND c_name < 'Customer#000000900' AND c_mktsegment > 'C' OR c_mktsegment <= 'AUTOMOBILE'")
def filter_text_order(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    named = all_of(compare(t, "c_name", ">=", "Customer#000000500"), compare(t, "c_name", "<", "Customer#000000900"), compare(t, "c_mktsegment", ">", "C"))
    return rows.narrow(rows.keep(t, any_of(named, compare(t, "c_mktsegment", "<=", "AUTOMOBILE"))), ["c_custkey", "c_name"])


@query("SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part WHERE p_size < 5 OR NOT (p_size <= 45) OR p_brand = 'Brand#11'")
def filter_or_not(spark, sf_dir):
    t = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return rows.keep(t, any_of(compare(t, "p_size", "<", 5), ~compare(t, "p_size", "<=", 45), compare(t, "p_brand", "=", "Brand#11")))


@query("SELECT l_orderkey, nullif(l_linenumber, 3)::BIGINT AS n FROM lineitem WHERE nullif(l_linenumber, 3) IS NULL OR NOT (nullif(l_linenumber, 3) > 2)")
def filter_three_valued(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"))
    return rows.keep(t, any_of(F.col("n").isNull(), ~compare(t, "n", ">", 2)))


@query("SELECT c_custkey, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_nationkey IN (3, 7, 11) AND c_mktsegment NOT IN ('BUILDING')")
def filter_in_list(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return rows.keep_chained(t, [~in_list(t, "c_mktsegment", ["BUILDING"]), in_list(t, "c_nationkey", [3, 7, 11])], [1, 0])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) IS DISTINCT FROM nullif(l_linenumber, 5)")
def filter_differs(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.keep(t, differs(F.nullif("l_linenumber", F.lit(3)), F.nullif("l_linenumber", F.lit(5))))


@query("SELECT l_orderkey, coalesce(nullif(l_linenumber, 3), -1)::BIGINT AS n FROM lineitem")
def fill_nulls(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"))
    return rows.fill_null(t, {"n": -1})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 1001")
def point_lookup(spark, sf_dir):
    t = load(spark, sf_dir, "orders")
    return parquet.scan(t, ["o_orderkey", "o_totalprice"], compare(t, "o_orderkey", "=", 1001))


@query("SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def side_by_side(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    orders = aggregates.group(rows.rename(o, {"o_custkey": "c_custkey"}), ["c_custkey"], [Aggregate("n", "count_star")])
    return rows.side_by_side(c.select("c_custkey", "c_name"), orders, ["c_custkey"])


# joins

_ORDERS_OF_CUSTOMERS = "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"


def _orders_of_customers(spark, sf_dir, strategy=None):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return joins.inner_join(o, c, ["o_custkey"], ["c_custkey"], strategy=strategy).drop("c_custkey")


@query(_ORDERS_OF_CUSTOMERS)
def inner_join(spark, sf_dir):
    return _orders_of_customers(spark, sf_dir)


@query(_ORDERS_OF_CUSTOMERS)
def inner_join_hash(spark, sf_dir):
    return _orders_of_customers(spark, sf_dir, "hash")


@query(_ORDERS_OF_CUSTOMERS)
def inner_join_merge(spark, sf_dir):
    return _orders_of_customers(spark, sf_dir, "merge")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inner_join_nested_loop(spark, sf_dir):
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return joins.inner_join(s, n, ["s_nationkey"], ["n_nationkey"], strategy="nested_loop").select("s_suppkey", "s_name", "n_name")


@query(
    "SELECT a.l_orderkey, a.l_suppkey, a.n, b.l_orderkey AS l_orderkey_right, b.l_suppkey AS l_suppkey_right, b.n AS n_right FROM "
    "(SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a JOIN "
    "(SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey"
)
def inner_join_two_keys(spark, sf_dir):
    t, keys = load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"]
    a, b = (aggregates.group(rows.keep(t, compare(t, c, "=", v)), keys, [Aggregate("n", "count_star")]) for c, v in (("l_returnflag", "R"), ("l_linestatus", "F")))
    return joins.inner_join(a, b, keys, keys)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def left_outer_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return joins.left_outer(load(spark, sf_dir, "customer"), rows.keep(o, compare(o, "o_totalprice", ">", 300000.0)), ["c_custkey"], ["o_custkey"]).select("c_custkey", "o_orderkey")


_KEYS = "(SELECT nullif(c_nationkey, 3)::BIGINT AS k, count(*) AS n FROM customer WHERE c_nationkey < 18 GROUP BY 1) a"
_OTHER = "(SELECT nullif(s_nationkey, 5)::BIGINT AS k, count(*) AS n FROM supplier WHERE s_nationkey > 6 OR s_nationkey IN (3, 5) GROUP BY 1) b"


def _null_keyed(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    one = [Aggregate("n", "count_star")]
    a = aggregates.group(c.where("c_nationkey < 18").select(F.nullif("c_nationkey", F.lit(3)).alias("k")), ["k"], one)
    return a, aggregates.group(s.where("s_nationkey > 6 or s_nationkey in (3, 5)").select(F.nullif("s_nationkey", F.lit(5)).alias("k")), ["k"], one)


@query(f"SELECT a.k, a.n, b.k AS k_right, b.n AS n_right FROM {_KEYS} FULL JOIN {_OTHER} ON a.k = b.k")
def full_outer_join_null_keys(spark, sf_dir):
    return joins.full_outer(*_null_keyed(spark, sf_dir), ["k"], ["k"])


@query(f"SELECT a.k, a.n FROM {_KEYS} WHERE EXISTS (SELECT 1 FROM {_OTHER} WHERE a.k = b.k)")
def semi_join_null_keys(spark, sf_dir):
    return joins.semi(*_null_keyed(spark, sf_dir), ["k"], ["k"])


@query(f"SELECT a.k, a.n FROM {_KEYS} WHERE NOT EXISTS (SELECT 1 FROM {_OTHER} WHERE a.k = b.k)")
def anti_join_null_keys(spark, sf_dir):
    return joins.anti(*_null_keyed(spark, sf_dir), ["k"], ["k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def semi_join(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return joins.semi(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rows.keep(c, compare(c, "c_acctbal", "<", 0.0)), ["o_custkey"], ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
def anti_join(spark, sf_dir):
    return joins.anti(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders"), ["c_custkey"], ["o_custkey"])


@query("SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows, count(DISTINCT o_orderkey) AS matched_left, count(*) AS pairs FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_fanout(spark, sf_dir):
    counts = joins.fanout_counts(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"])
    return counts.select("left_rows", "right_rows", "matched_left", "pairs")


@query("SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS left_keys, count(DISTINCT c_custkey) AS matched_keys FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def key_coverage(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return joins.fanout_counts(load(spark, sf_dir, "customer"), rows.keep(o, compare(o, "o_totalprice", ">", 200000.0)), ["c_custkey"], ["o_custkey"]).select("left_keys", "matched_keys")


# aggregates


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, avg(l_quantity) AS avg_qty, "
    "min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n, count(nullif(l_linenumber, 3)) AS n_not_three FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
)
def pricing_summary(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    # cents add up the same in any order
    t = t.withColumns({"not_three": F.nullif("l_linenumber", F.lit(3)), "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint")})
    made = [Aggregate("sum_qty", "sum", "l_quantity"), Aggregate("avg_qty", "mean", "l_quantity"), Aggregate("n", "count_star"), Aggregate("n_not_three", "count", "not_three")]
    made += [Aggregate("min_price", "min", "l_extendedprice"), Aggregate("max_price", "max", "l_extendedprice"), Aggregate("sum_price", "sum", "cents")]
    return aggregates.group(t, ["l_returnflag", "l_linestatus"], made).withColumn("sum_price", F.col("sum_price") / 100)


@query("SELECT count(*) AS n, count(nullif(o_orderkey % 4, 0)) AS some, min(o_orderpriority) AS first, max(o_orderpriority) AS last, sum(o_custkey)::BIGINT AS total FROM orders")
def global_aggregate(spark, sf_dir):
    t = load(spark, sf_dir, "orders").withColumn("q", F.nullif(F.col("o_orderkey") % 4, F.lit(0)))
    return aggregates.group(t, [], [Aggregate("n", "count_star"), Aggregate("some", "count", "q"), Aggregate("first", "min", "o_orderpriority"), Aggregate("last", "max", "o_orderpriority"), Aggregate("total", "sum", "o_custkey")])


@query("SELECT nullif(l_linenumber, 3)::BIGINT AS k, count(*) AS n, sum(l_suppkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def group_null_key(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").withColumn("k", F.nullif("l_linenumber", F.lit(3)))
    return aggregates.group(t, ["k"], [Aggregate("n", "count_star"), Aggregate("total", "sum", "l_suppkey")])


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty, min(l_shipdate) AS first, max(l_partkey) AS last FROM lineitem GROUP BY 1")
def group_salted(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return aggregates.group_salted(t, ["l_returnflag"], [Aggregate("n", "count_star"), Aggregate("qty", "sum", "q"), Aggregate("first", "min", "l_shipdate"), Aggregate("last", "max", "l_partkey")], F.col("l_orderkey"))


@query("SELECT p_brand, bool_or(p_size > 49) AS any_large, bool_and(p_size > 1) AS all_some, bool_or(nullif(p_size, 7) % 2 = 1) AS any_odd FROM part GROUP BY 1")
def group_any_all(spark, sf_dir):
    t = load(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 49).alias("a"), (F.col("p_size") > 1).alias("b"), (F.nullif("p_size", F.lit(7)) % 2 == 1).alias("c"))
    return aggregates.group(t, ["p_brand"], [Aggregate("any_large", "any", "a"), Aggregate("all_some", "all", "b"), Aggregate("any_odd", "any", "c")])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def group_having(spark, sf_dir):
    g = aggregates.group(load(spark, sf_dir, "orders"), ["o_custkey"], [Aggregate("n", "count_star")])
    return rows.keep(g, compare(g, "n", ">", 15))


@query("SELECT r_name, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_and_group(spark, sf_dir):
    o, c = _money(load(spark, sf_dir, "orders"), "o_totalprice"), load(spark, sf_dir, "customer")
    j = joins.inner_join(joins.inner_join(o, c, ["o_custkey"], ["c_custkey"]), load(spark, sf_dir, "nation"), ["c_nationkey"], ["n_nationkey"])
    j = joins.inner_join(j, load(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"])
    return _doubles(j.groupBy("r_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))


# distinct


@query("SELECT DISTINCT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return distinct.values(t, "c_mktsegment", "sort")


@query("SELECT DISTINCT nullif(l_linenumber, 3)::BIGINT AS n FROM lineitem")
def distinct_values_hash(spark, sf_dir):
    return distinct.values(load(spark, sf_dir, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("n")), "n")


@query("SELECT DISTINCT p_type FROM part WHERE p_type <> 'none'")
def distinct_values_dictionary(spark, sf_dir):
    return distinct.values(load(spark, sf_dir, "part"), "p_type", "dictionary")


@query("SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS different, count(DISTINCT (o_custkey, o_orderstatus)) / count(*) AS share FROM orders")
def distinct_account(spark, sf_dir):
    return distinct.account(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_rows_first(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return distinct.rows(t, ["o_custkey"], [SortKey("o_totalprice", descending=True), SortKey("o_orderkey")])


@query("SELECT count(DISTINCT nullif(l_suppkey, 7)) AS n FROM lineitem")
def count_distinct(spark, sf_dir):
    return distinct.count_values(load(spark, sf_dir, "lineitem").select(F.nullif("l_suppkey", F.lit(7)).alias("k")), "k")


def _near(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The exact count, and whether the sketch's (both n, one row each) is within a twentieth of it, three times its standard error."""
    both = found.select(F.col("n").alias("f"), F.lit(1).alias("one")).join(exact.select("n", F.lit(1).alias("one")), "one")
    return both.select("n", (F.abs(F.col("f") - F.col("n")) <= F.col("n") / 20).alias("near"))


@query("SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
def count_distinct_sketch(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    return _near(distinct.count_values(t, "l_partkey", exact=False), distinct.count_values(t, "l_partkey"))


@query("SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
def count_distinct_merged_sketches(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    return _near(distinct.merged_count(distinct.sketches(t, "l_partkey", ["l_returnflag", "l_linenumber"])), distinct.count_values(t, "l_partkey"))


# windows


def _windowed(spark, sf_dir, *made: Window):
    t = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif(F.col("o_orderkey") % 7, F.lit(3)).alias("v"))
    return windows.apply(t, made)


_W = "SELECT o_orderkey, o_custkey, o_orderstatus, v, {} FROM (SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderkey % 7, 3) AS v FROM orders)"


@query(_W.format("row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC NULLS LAST, o_orderkey) AS k"))
def window_row_number(spark, sf_dir):
    return _windowed(spark, sf_dir, Window("k", "row_number", None, ["o_custkey"], [SortKey("v", descending=True), SortKey("o_orderkey")]))


@query(_W.format("rank() OVER w AS r, dense_rank() OVER w AS d").replace("orders)", "orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY v NULLS LAST)"))
def window_ranks(spark, sf_dir):
    return _windowed(spark, sf_dir, *[Window(n, f, None, ["o_custkey"], [SortKey("v")]) for n, f in (("r", "rank"), ("d", "dense_rank"))])


@query(_W.format("sum(v::DOUBLE) OVER w AS s, max(v::DOUBLE) OVER w AS m").replace("orders)", "orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"))
def window_running(spark, sf_dir):
    return _windowed(spark, sf_dir, *[Window(n, f, "v", ["o_custkey"], [SortKey("o_orderkey")]) for n, f in (("s", "running_sum"), ("m", "running_max"))])


@query(_W.format("lag(v) OVER w AS a, lead(o_orderstatus, 2) OVER w AS b").replace("orders)", "orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"))
def window_lag_lead(spark, sf_dir):
    order = [SortKey("o_orderkey")]
    return _windowed(spark, sf_dir, Window("a", "lag", "v", ["o_custkey"], order), Window("b", "lead", "o_orderstatus", ["o_custkey"], order, 2))


@query("SELECT o_custkey, max(k) AS last, count(DISTINCT k) AS different FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey) AS k FROM orders) GROUP BY 1")
def window_row_number_unordered(spark, sf_dir):
    t = windows.apply(load(spark, sf_dir, "orders").select("o_custkey"), [Window("k", "row_number", None, ["o_custkey"])])
    return t.groupBy("o_custkey").agg(F.max("k").alias("last"), F.count_distinct("k").alias("different"))


# sorts and limits


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten(spark, sf_dir):
    return sorting.top_k(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [SortKey("o_totalprice", descending=True), SortKey("o_orderkey")], 10)


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, nullif(o_orderkey % 7, 3) AS v FROM orders) ORDER BY v DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 5")
def sort_nulls_first_offset(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderkey") % 7, F.lit(3)).alias("v"))
    return sorting.limit(sorting.order_by(t, [SortKey("v", True, nulls_first=True), SortKey("o_orderkey")]), 25, 5)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 40 OFFSET 100")
def row_positions(spark, sf_dir):
    return rows.positions(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), [SortKey("event_id")], 100, 140)


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey, c_name FROM customer ORDER BY ALL")
def sort_all(spark, sf_dir):
    return sorting.order_by(load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), [SortKey("c_nationkey"), SortKey("c_custkey"), SortKey("c_name")])


# set operations


def _two_sides(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    return c.where("c_nationkey < 18").select(F.nullif("c_nationkey", F.lit(3)).alias("k")), s.where("s_nationkey > 6 or s_nationkey = 3").select(F.nullif("s_nationkey", F.lit(3)).alias("k"))


_A, _B = "SELECT nullif(c_nationkey, 3)::BIGINT AS k FROM customer WHERE c_nationkey < 18", "SELECT nullif(s_nationkey, 3)::BIGINT AS k FROM supplier WHERE s_nationkey > 6 OR s_nationkey = 3"


@query(f"{_A} UNION ALL {_B}")
def union_all(spark, sf_dir):
    return sets.union_all(*_two_sides(spark, sf_dir))


@query(f"{_A} UNION {_B}")
def union(spark, sf_dir):
    return sets.union(*_two_sides(spark, sf_dir), ordered=True)


@query(f"{_A} INTERSECT {_B}")
def intersect(spark, sf_dir):
    return sets.intersect(*_two_sides(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def difference(spark, sf_dir):
    return sets.difference(*_two_sides(spark, sf_dir))


@query(
    f"WITH a AS ({_A}), b AS ({_B}), n AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM (FROM a UNION FROM b)) AS in_either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS in_both, "
    "(SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS in_left_only) SELECT *, rows - in_either AS duplicates, (rows - in_either) / rows AS share FROM n"
)
def set_account(spark, sf_dir):
    return sets.account(*_two_sides(spark, sf_dir))


@query("SELECT DISTINCT l_returnflag, l_linestatus, nullif(l_linenumber, 3)::BIGINT AS n FROM lineitem")
def distinct_table(spark, sf_dir):
    return sets.distinct(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.nullif("l_linenumber", F.lit(3)).alias("n")))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def stack_tables(spark, sf_dir):
    return rows.stack(*[load(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))])


# casts and parses


@query("SELECT c_custkey, trunc(c_acctbal)::BIGINT AS c_acctbal, c_nationkey <> 0 AS c_nationkey FROM customer")
def cast_narrow(spark, sf_dir):
    return casting.cast_columns(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), {"c_acctbal": "integer", "c_nationkey": "boolean"})


@query("SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS d, o_custkey::DOUBLE AS o_custkey FROM orders")
def cast_widen(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_custkey")
    return casting.cast_columns(t, {"d": "integer", "o_custkey": "floating"})


@query("SELECT count(*) AS rows, count(*) FILTER (trunc(c_acctbal) <> c_acctbal) AS changed, 0::BIGINT AS nulls FROM customer")
def cast_loss(spark, sf_dir):
    return casting.loss_counts(load(spark, sf_dir, "customer"), "c_acctbal", "integer")


@query("SELECT l_orderkey, CASE WHEN l_linenumber <= 5 THEN trunc(l_quantity)::BIGINT END AS x FROM lineitem")
def cast_out_of_range(spark, sf_dir):
    odd = F.when(F.col("l_linenumber") == 6, F.lit(float("nan"))).when(F.col("l_linenumber") == 7, F.lit(1e30)).otherwise(F.col("l_quantity"))
    return casting.cast(load(spark, sf_dir, "lineitem").select("l_orderkey", odd.alias("x")), "x", "integer")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS d FROM orders")
def parse_date(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2021-02-30")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd"))
    return casting.parse(load(spark, sf_dir, "orders").select("o_orderkey", text.alias("d")), "d", "date", "null")


@query("SELECT c_custkey, TRY_CAST(c_name[10:] AS BIGINT) AS n FROM customer")
def parse_integer(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select("c_custkey", F.expr("substring(c_name, 10)").alias("n"))
    return casting.parse(t, "n", "integer", "null")


@query("SELECT l_orderkey, w = 'yes' AS w FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'NO' ELSE 'maybe' END AS w FROM lineitem) WHERE w <> 'maybe'")
def parse_boolean_skip(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "NO").otherwise("maybe").alias("w"))
    return casting.parse(t, "w", "boolean", "skip")


# layouts, files, statistics


#: Rows that a task sorts: with a fixed number of files, its memory would grow with the table.
ROWS_PER_TASK = 1 << 20


def _stored(spark, sf_dir, order, *keys):
    path = new_path(spark, f"layout-{order}")
    parquet.write(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), path, order, keys, files=8, bloom=["l_orderkey"], rows_per_task=ROWS_PER_TASK)
    return parquet.open_table(spark, path)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_partkey BETWEEN 100 AND 160")
def scan_sorted_layout(spark, sf_dir):
    t = _stored(spark, sf_dir, "sorted", "l_partkey")
    return parquet.scan(t, ["l_orderkey", "l_quantity"], F.col("l_partkey").between(100, 160))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < 60 AND l_suppkey < 20")
def scan_interleaved_layout(spark, sf_dir):
    t = _stored(spark, sf_dir, "interleaved", "l_partkey", "l_suppkey")
    return parquet.scan(t, ["l_orderkey", "l_partkey", "l_suppkey"], (F.col("l_partkey") < 60) & (F.col("l_suppkey") < 20))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def scan_clustered_layout(spark, sf_dir):
    return aggregates.group(_stored(spark, sf_dir, "clustered", "l_suppkey"), ["l_suppkey"], [Aggregate("n", "count_star")])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def compacted_fragments(spark, sf_dir):
    small, large = new_path(spark, "fragments"), new_path(spark, "compacted")
    parquet.ingest(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), small, 5_000)
    parquet.compact(spark, small, large)
    return parquet.open_table(spark, large)


@query("SELECT min(l_partkey) AS low, max(l_partkey) AS high, count(*) AS rows, 0::BIGINT AS nulls FROM lineitem")
def zone_maps(spark, sf_dir):
    zones = parquet.zone_map(_stored(spark, sf_dir, "sorted", "l_partkey"), ["l_partkey"])
    return zones.agg(F.min(F.col("low").cast("long")).alias("low"), F.max(F.col("high").cast("long")).alias("high"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"))


_WIDTH = "CASE WHEN p_size = 50 THEN 10 ELSE 1 + floor((p_size - 1) / 4.9)::INT END"


@query(f"SELECT {_WIDTH} AS bucket, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, count(*) AS rows, count(DISTINCT p_size) AS distinct FROM part GROUP BY 1".replace("AS distinct", 'AS "distinct"'))
def histogram_equi_width(spark, sf_dir):
    return statistics.equi_width_buckets(load(spark, sf_dir, "part"), "p_size", 10)


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS rows, 32::BIGINT AS buckets, true AS in_order, true AS even FROM orders")
def histogram_equi_depth(spark, sf_dir):
    made = statistics.equi_depth_buckets(load(spark, sf_dir, "orders"), "o_totalprice")
    follows = F.coalesce(F.col("low") > F.col("before"), F.lit(True)) & (F.col("low") <= F.col("high"))
    by_bucket = made.withColumn("before", F.expr("lag(high) OVER (ORDER BY bucket)"))  # 32 rows
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.count("*").alias("buckets")]
    return by_bucket.agg(*ends, F.bool_and(follows).alias("in_order"), (F.max("rows") <= 1.25 * F.avg("rows")).alias("even"))


@query("SELECT count(*) FILTER (p_size < 10) / count(*) AS small, count(*) FILTER (p_size < 10 AND NOT p_brand IN ('Brand#11', 'Brand#23')) / count(*) AS small_other, count(*) FILTER (nullif(p_size, 7) IS NULL OR p_size > 48) / count(*) AS odd FROM part")
def predicate_shares(spark, sf_dir):
    t = load(spark, sf_dir, "part")
    small = compare(t, "p_size", "<", 10)
    conditions = {"small": small, "small_other": all_of(small, ~in_list(t, "p_brand", ["Brand#11", "Brand#23"])), "odd": any_of(F.nullif("p_size", F.lit(7)).isNull(), compare(t, "p_size", ">", 48))}
    return statistics.shares(t, conditions)


@query("SELECT count(*) AS rows, min(l_partkey) AS low_l_partkey, max(l_partkey) AS high_l_partkey, min(l_quantity) AS low_l_quantity, max(l_quantity) AS high_l_quantity FROM lineitem")
def footer_facts(spark, sf_dir):
    return parquet.footer_facts(spark, f"{sf_dir}/lineitem.parquet", ["l_partkey", "l_quantity"])


@query("SELECT count(*) AS rows, count(*) FILTER (o_totalprice > 250000) AS kept FROM orders")
def catalogue_tables(spark, sf_dir):
    path = new_path(spark, "catalogue")
    c = Catalogue(spark)
    c.open_all(sf_dir, ["orders", "customer"])
    c.analyse("orders")
    c.save(path)
    found = Catalogue.load(spark, path)
    assert not found.entry("orders").stale()
    t = found.table("orders")
    return t.agg(F.count("*").alias("rows"), F.count_if(compare(t, "o_totalprice", ">", 250000.0)).alias("kept"))


@query(
    "SELECT user_id, run, any_value(event_type) AS value, count(*) AS rows, min(k) AS start FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM "
    "(SELECT user_id, event_id, event_type, row_number() OVER w AS k, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY 1, 2"
)
def run_lengths(spark, sf_dir):
    return statistics.run_lengths(load(spark, sf_dir, "events"), "event_type", ["event_id"], ["user_id"])


@query("SELECT count(l_suppkey) * 8 AS plain, (ceil(log2(max(l_suppkey) - min(l_suppkey) + 1)) * count(l_suppkey) / 8)::BIGINT AS packed FROM lineitem")
def encoding_sizes(spark, sf_dir):
    return statistics.encoding_advice(load(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("plain").cast("long").alias("plain"), F.col("packed").cast("long").alias("packed"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def correlation(spark, sf_dir):
    return statistics.correlation_of(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"))


@query(
    "WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY ALL), x AS (SELECT a, sum(p) AS p FROM j GROUP BY 1), y AS (SELECT b, sum(p) AS p FROM j GROUP BY 1), "
    "e AS (SELECT (SELECT -sum(p * log2(p)) FROM x) AS hx, (SELECT -sum(p * log2(p)) FROM y) AS hy, (SELECT -sum(p * log2(p)) FROM j) AS hj) SELECT round(greatest(0, hx + hy - hj) / least(hx, hy), 6) AS m FROM e"
)
def mutual_information(spark, sf_dir):
    return statistics.information_of(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("m", 6).alias("m"))


# SQL text and chains of stages

_TEXT = "SELECT DISTINCT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT o_orderstatus = 'F' AND c_acctbal IS NOT NULL GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY n DESC, segment LIMIT 3 OFFSET 1"


@query(_TEXT)
def sql_text(spark, sf_dir):
    for name in ("orders", "customer"):
        parquet.open_table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return sql.query(spark, _TEXT)


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE value > 10 GROUP BY 1")
def stage_chain(spark, sf_dir):
    t = load(spark, sf_dir, "events")
    stages = [pipeline.filter_stage(compare(t, "value", ">", 10.0)), pipeline.project_stage(["event_type", "event_id"]), pipeline.aggregate_stage(["event_type"], [Aggregate("n", "count_star"), Aggregate("first", "min", "event_id")])]
    return pipeline.run(t, stages)


@query("SELECT user_id, event_id, value FROM events WHERE event_type <> 'click' ORDER BY value DESC, event_id")
def stage_chain_sorted(spark, sf_dir):
    t = load(spark, sf_dir, "events")
    stages = [pipeline.filter_stage(compare(t, "event_type", "!=", "click")), pipeline.project_stage(["user_id", "event_id", "value"]), pipeline.sort_stage([SortKey("value", descending=True), SortKey("event_id")])]
    return pipeline.run(t, stages)


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events WHERE value > 10 GROUP BY 1")
def streamed_totals(spark, sf_dir):
    """The same rows as they arrive in files, by Structured Streaming."""
    sink, t = new_path(spark, "streamed"), load(spark, sf_dir, "events")
    arriving = new_path(spark, "arriving")
    t.select("event_type", "user_id", "value").write.option("maxRecordsPerFile", 100_000).parquet(arriving)
    stream = spark.readStream.schema(spark.read.parquet(arriving).schema).parquet(arriving)
    stages = [pipeline.filter_stage(F.col("value") > 10.0), pipeline.aggregate_stage(["event_type"], [Aggregate("n", "count_star"), Aggregate("users", "sum", "user_id")])]
    pipeline.by_batches(stream, stages, sink, new_path(spark, "progress"), "complete")
    return parquet.open_table(spark, sink)


FLAGSHIP = "pricing_summary"

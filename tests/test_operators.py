import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.errors import BudgetExceeded, ConfigError, DataError, PlanError, SchemaError, TypeMismatch, UnknownColumn
from sparkloom.functions import casting
from sparkloom.functions.predicates import all_of, any_of, arithmetic, compare, differs, in_list
from sparkloom.operators import aggregates, distinct, joins, rows, sets, sorting, windows
from sparkloom.operators.aggregates import Aggregate
from sparkloom.operators.sorting import SortKey
from sparkloom.operators.windows import Window
from sparkloom.plans import observe, sql
from sparkloom.schema import common_type, infer, joined_names, literal_table
from sparkloom.verify.compare import agree


def got(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_schema_rules(spark):
    assert joined_names(["k", "k_right"], ["k", "v"]) == ["k_right_right", "v"]
    assert common_type("integer", "floating") == "floating"
    assert infer([None, 1, 2.5]) == "floating" and infer([datetime.date(2020, 1, 1)]) == "date"
    for bad in ([None], [1, "x"]):
        with pytest.raises(SchemaError):
            infer(bad)
    with pytest.raises(TypeMismatch):
        common_type("integer", "string")
    assert literal_table(spark, a=[1, 2.0]).dtypes == [("a", "double")]


def test_projection(sample):
    assert rows.narrow(sample, ["v", "a"]).columns == ["v", "a"]
    assert rows.project(sample, ["w"], {"w": F.col("v") * 2}).columns == ["w"]
    for call, error in (
        (lambda: rows.narrow(sample, ["z"]), UnknownColumn),
        (lambda: rows.narrow(sample, ["a", "a"]), SchemaError),
        (lambda: rows.narrow(sample, []), ConfigError),
        (lambda: rows.drop(sample, ["a", "g", "v"]), SchemaError),
        (lambda: rows.rename(sample, {"a": "g"}), SchemaError),
        (lambda: rows.compute(sample, {"a": F.lit(1)}), SchemaError),
    ):
        with pytest.raises(error):
            call()
    assert rows.replace(sample, {"v": F.col("a") + 1, "b": F.col("v")}).columns == ["a", "g", "v", "b"]
    assert got(rows.replace(sample, {"v": F.col("a") + 1, "b": F.col("v")}), "v", "b") == sorted([(2, 1.5), (3, 2.5), (None, 3.5), (5, 4.5)], key=repr)
    with pytest.raises(Exception):  # a computed column can't see its sibling
        rows.compute(sample, {"b": F.col("a") + 1, "c": F.col("b") + 1})


def test_filters_with_three_truth_values(sample):
    big = compare(sample, "a", ">", 1)
    assert got(rows.keep(sample, big), "v") == [(2.5,), (4.5,)]
    assert got(rows.keep(sample, ~big), "v") == [(1.5,)]
    assert rows.keep(sample, any_of(big, sample.a.isNull())).count() == 3
    assert rows.keep(sample, all_of()).count() == 4
    assert rows.keep(sample, in_list(sample, "g", ["x"])).count() == 2
    assert rows.keep(sample, differs(sample.g, F.lit("x"))).count() == 2
    assert rows.keep_chained(sample, [big, sample.g.isNull()], [1, 0]).count() == 1
    for call in (lambda: compare(sample, "g", "=", 1), lambda: rows.keep(sample, sample.a + 1), lambda: arithmetic(sample, "g", "+", "x")):
        with pytest.raises(TypeMismatch):
            call()
    with pytest.raises(ConfigError):
        in_list(sample, "a", [])


def test_positions_and_fill(sample):
    assert [r.v for r in rows.positions(sample, [SortKey("a")], 1, 3).collect()] == [2.5, 4.5]
    assert [r.v for r in rows.positions(sample, [SortKey("a")], 3).collect()] == [3.5]
    assert rows.positions(sample, [SortKey("a")], 9, 12).count() == 0
    assert got(rows.fill_null(sample, {"a": 0}), "a") == [(0,), (1,), (2,), (4,)]
    assert got(rows.numbered(sample, [SortKey("v")], "k", ["g"]), "g", "k") == [("x", 0), ("x", 1), ("y", 0), (None, 0)]


def test_joins_with_null_keys_and_clashing_names(spark, sample):
    right = literal_table(spark, g=["x", None, "z"], v=[9.0, 8.0, 7.0])
    assert joins.inner_join(sample, right, ["g"], ["g"]).columns == ["a", "g", "v", "g_right", "v_right"]
    assert joins.inner_join(sample, right, ["g"], ["g"]).count() == 2
    assert joins.left_outer(sample, right, ["g"], ["g"]).count() == 4
    full = got(joins.full_outer(sample, right, ["g"], ["g"]), "a", "g_right", "v_right")
    assert (None, "z", 7.0) in full and (None, None, 8.0) in full and len(full) == 6
    assert joins.semi(sample, right, ["g"], ["g"]).count() == 2
    assert got(joins.anti(sample, right, ["g"], ["g"]), "v") == [(2.5,), (4.5,)]
    f = joins.fanout(sample, right, ["g"], ["g"])
    assert (f.left_rows, f.right_rows, f.matched_left, f.pairs, f.fanout) == (4, 3, 2, 2, 0.5)
    assert tuple(joins.fanout_counts(sample, right, ["g"], ["g"]).select("left_keys", "matched_keys").first()) == (2, 1)
    with pytest.raises(TypeMismatch):
        joins.inner_join(sample, right, ["a"], ["g"])
    with pytest.raises(ConfigError):
        joins.semi(sample, right, [], [])


def test_join_strategies_agree_and_are_what_was_asked(spark):
    left = spark.range(500).select((F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    right = spark.range(80).select((F.col("id") % 50).alias("k"), F.col("id").alias("w"))
    made = {s: joins.inner_join(left, right, ["k"], ["k"], strategy=s) for s in joins.STRATEGIES}
    for s, operator in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct")):
        assert operator in observe.strategies(made[s])
        assert agree(made[s], made[None])


def test_groups(sample, spark):
    made = [Aggregate("n", "count_star"), Aggregate("c", "count", "a"), Aggregate("s", "sum", "a"), Aggregate("m", "mean", "v"), Aggregate("hi", "max", "g"), Aggregate("y", "any", "a")]
    assert got(aggregates.group(sample, ["g"], made)) == sorted([("x", 2, 1, 1, 2.5, "x", True), ("y", 1, 1, 2, 2.5, "y", True), (None, 1, 1, 4, 4.5, None, True)], key=repr)
    assert got(aggregates.group(sample.limit(0), [], made[:3])) == [(0, 0, None)]
    assert aggregates.group(sample.limit(0), ["g"], made).count() == 0
    salted = aggregates.group_salted(sample, ["g"], made[:3], F.col("v"))
    assert agree(salted, aggregates.group(sample, ["g"], made[:3]))
    for a, error in ((Aggregate("s", "sum", "g"), TypeMismatch), (Aggregate("s", "median", "a"), ConfigError), (Aggregate("s", "sum"), ConfigError), (Aggregate("s", "sum", "z"), UnknownColumn)):
        with pytest.raises(error):
            aggregates.group(sample, ["g"], [a])
    with pytest.raises(ConfigError):
        aggregates.group(sample, ["g"], [])


def test_distinct_and_sets(spark, sample):
    assert [r.g for r in distinct.values(sample, "g", "sort").collect()] == ["x", "y", None]
    assert got(distinct.values(sample, "g", "dictionary")) == [("x",), ("y",)]
    assert got(distinct.rows(sample, ["g"], [SortKey("v", descending=True)]), "g", "v") == [("x", 3.5), ("y", 2.5), (None, 4.5)]
    assert distinct.count_values(sample, "g").first().n == 2 == distinct.count_values(sample, "g", exact=False).first().n
    a, b = literal_table(spark, k=[1, 1, None, 2]), literal_table(spark, k=[None, 2, 3])
    assert got(sets.union(a, b)) == [(1,), (2,), (3,), (None,)]
    assert got(sets.intersect(a, b)) == [(2,), (None,)]
    assert got(sets.difference(a, b)) == [(1,)]
    assert sets.union_all(a, b).count() == 7
    assert [r.k for r in sets.distinct(a, ordered=True).collect()] == [1, 2, None]
    assert tuple(sets.account(a, b).first()) == (7, 4, 2, 1, 3, 3 / 7) and tuple(sets.account(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    assert tuple(distinct.account(sample, ["g"]).first()) == (4, 3, 0.75) and tuple(distinct.account(sample.limit(0)).first()) == (0, 0, 0.0)
    kept = distinct.sketches(sample, "a", ["g"])
    assert distinct.merged_count(kept).first().n == 3 and got(distinct.merged_count(kept, ["g"])) == sorted([("x", 1), ("y", 1), (None, 1)], key=repr)
    with pytest.raises(TypeMismatch):
        sets.union(a, literal_table(spark, k=["x"]))
    with pytest.raises(TypeMismatch):
        distinct.values(sample, "a", "dictionary")


def test_windows(sample):
    order = [SortKey("v")]
    w = [Window("r", "row_number", None, ["g"], order), Window("s", "running_sum", "a", [], order), Window("p", "lag", "g", [], order), Window("q", "lead", "a", [], order, 2)]
    assert [(r.r, r.s, r.p, r.q) for r in windows.apply(sample, w).orderBy("v").collect()] == [(1, 1.0, None, None), (1, 3.0, "x", 4), (2, 3.0, "y", None), (1, 7.0, "x", None)]
    assert got(windows.apply(sample.select("g"), [Window("r", "row_number", None, ["g"])])) == sorted([("x", 1), ("x", 2), ("y", 1), (None, 1)], key=repr)
    ties = windows.apply(sample, [Window("k", "rank", None, [], [SortKey("g")]), Window("d", "dense_rank", None, [], [SortKey("g")])])
    assert got(ties, "g", "k", "d") == [("x", 1, 1), ("x", 1, 1), ("y", 3, 2), (None, 4, 3)]
    for bad, error in ((Window("r", "rank", None, ["g"]), ConfigError), (Window("a", "lag", "a", [], order), SchemaError), (Window("r", "running_sum", "g", [], order), TypeMismatch), (Window("r", "lag", "a", [], order, 0), ConfigError)):
        with pytest.raises(error):
            windows.apply(sample, [bad])


def test_sorts_put_nulls_last_and_limits(sample):
    assert [r.a for r in sorting.order_by(sample, [SortKey("a", descending=True)]).collect()] == [4, 2, 1, None]
    assert [r.a for r in sorting.order_by(sample, [SortKey("a", nulls_first=True)]).collect()] == [None, 1, 2, 4]
    assert sorting.top_k(sample, [SortKey("a")], 0).count() == 0
    assert sorting.limit(sample, None, 3).count() == 1 and sorting.limit(sample, 5, 9).count() == 0
    top = sorting.top_k(sample, [SortKey("a")], 2)
    assert "TakeOrderedAndProject" in observe.strategies(top)


def test_casts_and_parses(spark, sample):
    assert got(casting.cast(sample, "v", "integer"), "v") == [(1,), (2,), (3,), (4,)]
    negative = literal_table(spark, v=[-1.5, None])
    assert got(casting.cast(negative, "v", "integer")) == [(-1,), (None,)]
    days = literal_table(spark, d=[datetime.date(1970, 1, 3), None])
    assert got(casting.cast(days, "d", "integer")) == [(2,), (None,)]
    assert got(casting.cast(casting.cast(days, "d", "integer"), "d", "date")) == got(days)
    assert casting.loss(sample, "v", "integer").changed == 4 and casting.loss(sample, "a", "floating").lossless
    text = literal_table(spark, s=[" 7 ", "x", None, "-3"])
    assert got(casting.parse(text, "s", "integer", "null")) == [(-3,), (7,), (None,), (None,)]
    assert casting.parse(text, "s", "integer", "skip").count() == 2
    with pytest.raises(DataError):
        casting.parse(text, "s", "integer")
    odd = literal_table(spark, v=[float("nan"), 1e30, -(2.0**63), 2.0**63, float("-inf"), 2.5, None])
    assert got(casting.cast(odd, "v", "integer")) == sorted([(None,)] * 5 + [(-(2**63),), (2,)], key=repr)
    assert casting.loss(odd, "v", "integer") == casting.Loss(7, 5, 1)
    assert got(casting.parse(literal_table(spark, s=["2020-02-29", "2021-02-29"]), "s", "date", "null")) == sorted([(datetime.date(2020, 2, 29),), (None,)], key=repr)
    flags = literal_table(spark, s=["Yes", "0", "t"])
    assert got(casting.parse(flags, "s", "boolean", "null")) == [(False,), (None,), (True,)]
    for call in (lambda: casting.cast(text, "s", "integer"), lambda: casting.parse(sample, "a", "integer")):
        with pytest.raises(TypeMismatch):
            call()
    assert casting.what_it_loses("floating", "integer") == "the fraction" and not casting.can_narrow("string", "integer")


def test_sql_refusals(spark, sample):
    assert got(sql.query(spark, "select g, count(*) as n from {t} group by g", t=sample)) == [("x", 2), ("y", 1), (None, 1)]
    with pytest.raises(sql.SqlError) as e:
        sql.query(spark, "select (1 from")
    assert e.value.line == 1
    with pytest.raises(UnknownColumn):
        sql.query(spark, "select z from {t}", t=sample)
    with pytest.raises(PlanError):
        sql.query(spark, "drop table t")


def test_meter_counts_what_flows(sample):
    meter = observe.Meter()
    meter.watch(sample.where("a > 1"), "kept").collect()
    assert meter.rows("kept") == 2 and meter.values("kept") == 6
    with pytest.raises(BudgetExceeded) as e:
        meter.check({"kept": 5})
    assert e.value.overrun == 1
    steps = [("filter", lambda d: d.where("a > 1")), ("narrow", lambda d: d.select("a"))]
    assert observe.attribute(steps, sample) == {"source": 12, "filter": -6, "narrow": -4}


def test_agreement_has_a_negative_control(sample):
    assert agree(sample, sample.orderBy("v"))
    assert not agree(sample, sample.limit(3))
    assert not agree(sample, sample.withColumn("v", F.col("v") + 0.001))
    assert not agree(sample, sample.union(sample.limit(1)))

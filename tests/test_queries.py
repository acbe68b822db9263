import math
import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.operators import aggregates, rows
from sparkloom.operators.aggregates import Aggregate
from sparkloom.schema import literal_table

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return f"{x:.9g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def same(rows_, other):
    return sorted([[plain(x) for x in r] for r in rows_], key=repr) == sorted([[plain(x) for x in r] for r in other], key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    if name not in queries.SQL:
        assert found.count() > 0
        return
    expected = duck.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert same(found.select(*[F.col(f"`{n}`") for n in names]).collect(), expected.fetchall())


def test_entry_without_the_text_operators():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=hs.lists(hs.tuples(hs.one_of(hs.none(), hs.integers(-3, 3)), hs.one_of(hs.none(), hs.sampled_from("abc"))), min_size=1, max_size=30), bound=hs.integers(-3, 3))
def test_random_tables_against_sql(spark, data, bound):
    a, b = zip(*data)
    t = literal_table(spark, a=[0, *a], b=["a", *b])
    kept = rows.keep(t, (F.col("a") > bound) | ~(F.col("b") == "a"))
    found = aggregates.group(kept, ["b"], [Aggregate("n", "count_star"), Aggregate("s", "sum", "a"), Aggregate("m", "min", "a")]).collect()
    con = duckdb.connect()
    con.execute("create table t (a bigint, b varchar)")
    con.executemany("insert into t values (?, ?)", [(0, "a"), *data])
    assert same(found, con.execute("select b, count(*), sum(a), min(a) from t where a > ? or not (b = 'a') group by b", [bound]).fetchall())

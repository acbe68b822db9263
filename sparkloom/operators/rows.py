"""Projection, filters and row positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import ConfigError, SchemaError, TypeMismatch
from sparkloom.operators.sorting import SortKey, columns_of
from sparkloom.schema import distinct_names, logical, need


def narrow(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in that order. None, unknown and repeated names are refused."""
    need(df, *distinct_names(names))
    return df.select(*names)


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All but the named columns. Unknown names, and dropping every column, are refused."""
    need(df, *distinct_names(names))
    if len(names) == len(df.columns):
        raise SchemaError("nothing would be left")
    return df.drop(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Columns under new names. Unknown and clashing names are refused."""
    need(df, *distinct_names(mapping))
    distinct_names([mapping.get(c, c) for c in df.columns])
    return df.withColumnsRenamed(dict(mapping))


def compute(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df and new columns. Every expression sees df alone, none of the others; a name that df has is refused."""
    for name in distinct_names(columns):
        if name in df.columns:
            raise SchemaError(f"{name} is there already")
    for expr in columns.values():
        df.select(expr)  # alone it can't see a sibling's alias
    return df.select("*", *[e.alias(n) for n, e in columns.items()])


def replace(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with columns that take the place of those of their name or, if df has none, stand behind the others. Every expression sees df as it was."""
    made = {n: columns[n].alias(n) for n in distinct_names(columns)}
    for expr in made.values():
        df.select(expr)
    return df.select(*[made[c] if c in made else F.col(c) for c in df.columns], *[e for n, e in made.items() if n not in df.columns])


def project(df: DataFrame, names: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """compute, then narrow."""
    return narrow(compute(df, columns), names)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true. One that isn't boolean is refused."""
    kind = df.select(predicate.alias("p")).schema["p"].dataType
    if not isinstance(kind, T.BooleanType):
        raise TypeMismatch(f"a predicate must be boolean, not {logical(kind)}")
    return df.where(predicate)


def keep_chained(df: DataFrame, conjuncts: Sequence[Column], order: Sequence[int] | None = None) -> DataFrame:
    """The conjuncts one after another in the given order. Catalyst merges the filters and evaluates them as written."""
    order = range(len(conjuncts)) if order is None else order
    if sorted(order) != list(range(len(conjuncts))):
        raise ConfigError("the order must name every conjunct once")
    return reduce(lambda d, i: keep(d, conjuncts[i]), order, df)


def nothing(df: DataFrame) -> DataFrame:
    return df.limit(0)


def positions(df: DataFrame, keys: Sequence[SortKey], first: int = 0, last: int | None = None) -> DataFrame:
    """Rows first to last - 1 of df in the order of keys; which is a top-k for Spark, not a full sort."""
    if first < 0 or (last is not None and last < first):
        raise ConfigError(f"no rows from {first} to {last}")
    rows = df.orderBy(*columns_of(df, keys)).offset(first)
    return rows if last is None else rows.limit(last - first)


def numbered(df: DataFrame, keys: Sequence[SortKey], name: str, within: Sequence[str] = ()) -> DataFrame:
    """df and the place of each row, from 0, in the order of keys within equal values of the columns `within`."""
    if not within:
        raise ConfigError("places over a whole table need one task; name the columns within which to count")
    need(df, *within)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*columns_of(df, keys))).cast("long") - 1)


def stack(*tables: DataFrame) -> DataFrame:
    """All rows of tables that have the same columns and types in the same order."""
    from sparkloom.operators.sets import check_alike

    return reduce(lambda a, b: check_alike(a, b) or a.unionAll(b), tables)


def side_by_side(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns of two tables that share a row key, which is unique in both; other shared names are refused."""
    need(left, *key), need(right, *key)
    both = set(left.columns) & set(right.columns) - set(key)
    if both:
        raise SchemaError(f"in both tables: {sorted(both)}")
    return left.join(right, list(key))


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    need(df, *distinct_names(values))
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v).cast(df.schema[n].dataType)) for n, v in values.items()})

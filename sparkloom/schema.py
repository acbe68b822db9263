"""The five logical types, and checks of schemas that Spark itself would let pass."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import ConfigError, SchemaError, TypeMismatch, UnknownColumn

LOGICAL: dict[str, T.DataType] = {"boolean": T.BooleanType(), "integer": T.LongType(), "floating": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}
NUMERIC = ("integer", "floating")
_NARROW = (T.ByteType, T.ShortType, T.IntegerType)


def logical(kind: T.DataType) -> str:
    """Logical name of a Spark type; types outside the model go by Spark's own name."""
    if isinstance(kind, _NARROW):
        return "integer"
    if isinstance(kind, T.FloatType):
        return "floating"
    return next((k for k, v in LOGICAL.items() if v == kind), kind.simpleString())


def logical_of(df: DataFrame, name: str) -> str:
    return logical(df.schema[need(df, name)].dataType)


def need(df: DataFrame, *names: str) -> str:
    """Refuses names that df doesn't have; returns the first."""
    for name in names:
        if name not in df.columns:
            raise UnknownColumn(name, df.columns)
    return names[0]


def distinct_names(names: Iterable[str], what: str = "columns") -> list[str]:
    names = list(names)
    if not names:
        raise ConfigError(f"no {what} given")
    if len(set(names)) < len(names):
        raise SchemaError(f"{what} named twice: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def common_type(a: str, b: str) -> str:
    """The type that holds both: only integer and floating mix."""
    if a == b:
        return a
    if {a, b} == set(NUMERIC):
        return "floating"
    raise TypeMismatch(f"{a} and {b} have no common type")


def widened(df: DataFrame) -> DataFrame:
    """df with narrow integers as bigint and floats as double, the only numbers of the model."""
    return df.select(*[F.col(f.name).cast(LOGICAL[logical(f.dataType)]).alias(f.name) if logical(f.dataType) in NUMERIC else F.col(f.name) for f in df.schema.fields])


def joined_names(left: list[str], right: list[str], suffix: str = "_right") -> list[str]:
    """Names that right's columns get beside left's: the suffix is added until a name is new."""
    taken, out = set(left), []
    for name in right:
        while name in taken:
            name += suffix
        taken.add(name)
        out.append(name)
    return out


def infer(values: Iterable) -> str:
    """Logical type of Python values. Values without any that isn't None, and mixtures but of int and float, are refused."""
    kinds = {"boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "floating" if isinstance(v, float) else "string" if isinstance(v, str) else "date" if isinstance(v, datetime.date) else type(v).__name__ for v in values if v is not None}
    if not kinds:
        raise SchemaError("a column without values has no type")
    if kinds == set(NUMERIC):
        return "floating"
    if len(kinds) > 1 or not kinds <= set(LOGICAL):
        raise TypeMismatch(f"a column can't hold {sorted(kinds)}")
    return kinds.pop()


def literal_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of Python lists of one length, with inferred types."""
    if len({len(v) for v in columns.values()}) > 1:
        raise SchemaError("columns differ in length")
    kinds = {k: infer(v) for k, v in columns.items()}
    rows = [tuple(float(x) if kinds[k] == "floating" and x is not None else x for k, x in zip(columns, row)) for row in zip(*columns.values())]
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, LOGICAL[kinds[k]]) for k in columns]))


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def lit(value) -> Column:
    """A literal of the model: integers are bigint."""
    return F.lit(value).cast("bigint") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)

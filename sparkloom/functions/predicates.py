"""Conditions with three truth values, as columns with the type checks that Spark leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, TypeMismatch
from sparkloom.schema import common_type, infer, lit, logical, logical_of

COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def _kind(df: DataFrame, c: Column) -> str:
    return logical(df.select(c.alias("c")).schema["c"].dataType)


def compare(df: DataFrame, left: Column | str, sign: str, right) -> Column:
    """left sign right, null if either is. right: a column or a Python value. Text compares with text only."""
    a, b = (F.col(left) if isinstance(left, str) else left), (right if isinstance(right, Column) else lit(right))
    if sign not in COMPARE:
        raise ConfigError(f"no comparison {sign!r}")
    common_type(_kind(df, a), _kind(df, b))
    return COMPARE[sign](a, b)


def arithmetic(df: DataFrame, left: Column | str, sign: str, right) -> Column:
    """Sums, differences and products of numbers; an integer result out of range is refused when it comes up."""
    a, b = (F.col(left) if isinstance(left, str) else left), (right if isinstance(right, Column) else lit(right))
    if sign not in ARITHMETIC:
        raise ConfigError(f"no operation {sign!r}")
    if common_type(_kind(df, a), _kind(df, b)) not in ("integer", "floating"):
        raise TypeMismatch(f"{sign} is for numbers")
    return ARITHMETIC[sign](a, b)


def all_of(*conditions: Column) -> Column:
    """False if any is false, else null if any is null; true without conditions."""
    return reduce(and_, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(*conditions: Column) -> Column:
    if not conditions:
        raise ConfigError("no condition")
    return reduce(or_, conditions)


def in_list(df: DataFrame, name: str, options: Sequence) -> Column:
    """Whether the column has one of the values; null for null."""
    if not options:
        raise ConfigError("no options")
    if logical_of(df, name) == "string":
        options = [str(o) for o in options]
    common_type(logical_of(df, name), infer(options))
    return F.col(name).isin(*options)


def differs(left: Column, right: Column) -> Column:
    """Two-valued: nulls are equal to each other and differ from all else."""
    return ~left.eqNullSafe(right)

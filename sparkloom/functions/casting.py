"""Casts and parses between the logical types, with an account of what they change."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, DataError, TypeMismatch
from sparkloom.schema import LOGICAL, logical_of, need

WIDENING = {("boolean", "integer"), ("boolean", "floating"), ("integer", "floating"), ("date", "integer")}
NARROWING = {("floating", "integer"): "the fraction", ("integer", "boolean"): "all but zero or not", ("floating", "boolean"): "all but zero or not", ("integer", "date"): "nothing within the calendar"}
#: Range of floating numbers that have an integer.
LOWEST, ABOVE = -(2.0**63), 2.0**63
#: Spellings of truth values, in lower case.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
ON_ERROR = ("refuse", "null", "skip")


def can_widen(source: str, target: str) -> bool:
    return source == target or (source, target) in WIDENING


def can_narrow(source: str, target: str) -> bool:
    return (source, target) in NARROWING


def what_it_loses(source: str, target: str) -> str:
    return "nothing" if can_widen(source, target) else NARROWING.get((source, target), "it isn't allowed")


def _converted(c: Column, source: str, target: str) -> Column:
    if source == "date" and target == "integer":
        return F.unix_date(c).cast("bigint")
    if source == "integer" and target == "date":
        return F.date_from_unix_date(c.cast("int"))
    if source == "floating" and target == "integer":
        whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint")
        return F.when((c >= LOWEST) & (c < ABOVE), whole)  # NaN sorts as the largest number, so it is outside as well
    if source == "integer" and target == "boolean":
        return c != 0
    return c.cast(LOGICAL[target])


def cast(df: DataFrame, name: str, target: str) -> DataFrame:
    """df with the column in another type. Pairs that neither widen nor narrow, text among them, are refused; nulls stay. A floating number that no integer
    can stand for (NaN, infinite, out of range) becomes null, which `loss` counts as changed."""
    source = logical_of(df, need(df, name))
    if target not in LOGICAL:
        raise ConfigError(f"no type {target!r}")
    if not can_widen(source, target) and not can_narrow(source, target):
        raise TypeMismatch(f"{source} can't be cast to {target}; text is parsed")
    return df.withColumn(name, F.col(name) if source == target else _converted(F.col(name), source, target))


def cast_columns(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    for name, target in targets.items():
        df = cast(df, name, target)
    return df


@dataclass(frozen=True)
class Loss:
    """Values that don't come back when the cast is undone."""

    rows: int
    changed: int
    nulls: int

    @property
    def lossless(self) -> bool:
        return not self.changed


def loss_counts(df: DataFrame, name: str, target: str) -> DataFrame:
    """One row of rows, changed (values that don't come back when the cast is undone) and nulls; one aggregate over the column and its way there and back."""
    source = logical_of(df, need(df, name))
    cast(df, name, target)
    pair = df.select(F.col(name).alias("a"), (_converted(F.col(name), source, target) if source != target else F.col(name)).alias("b"))
    again = pair.select("a", (_converted(F.col("b"), target, source) if source != target else F.col("b")).alias("b"))
    return again.agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("a").isNull()).alias("nulls"))


def loss(df: DataFrame, name: str, target: str) -> Loss:
    return Loss(*loss_counts(df, name, target).first())


def _parsed(c: Column, target: str) -> Column:
    text = F.trim(c)
    if target == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if target == "integer":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    if target == "floating":
        return text.try_cast("double")
    return text.try_cast("date")


def parse(df: DataFrame, name: str, target: str, on_error: str = "refuse") -> DataFrame:
    """df with a text column read as integer, floating, boolean, or date. What can't be read, null included, is refused, made
    null or left out with its row."""
    if on_error not in ON_ERROR or target not in LOGICAL or target == "string":
        raise ConfigError(f"can't parse to {target!r} with {on_error!r}")
    if logical_of(df, need(df, name)) != "string":
        raise TypeMismatch(f"{name} is {logical_of(df, name)}, not string")
    made = _parsed(F.col(name), target)
    if on_error == "skip":
        return df.where(made.isNotNull()).withColumn(name, made)
    if on_error == "refuse":
        bad = df.where(made.isNull()).count()
        if bad:
            raise DataError(f"{bad} values of {name} aren't {target}")
    return df.withColumn(name, made)

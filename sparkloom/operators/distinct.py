"""Distinct values, rows and their counts. Null is one value; counts leave it out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, TypeMismatch
from sparkloom.operators.sorting import SortKey, columns_of
from sparkloom.schema import logical_of, need

PRECISION = 12


def values(df: DataFrame, name: str, strategy: str = "hash") -> DataFrame:
    """The different values of a column: in no order (hash), sorted with null last (sort), or of a text column only (dictionary)."""
    need(df, name)
    found = df.select(name).distinct()
    if strategy == "hash":
        return found
    if strategy == "sort":
        return found.orderBy(F.col(name).asc_nulls_last())
    if strategy == "dictionary":
        if logical_of(df, name) != "string":
            raise TypeMismatch(f"{name} is {logical_of(df, name)}, not string")
        return found.where(F.col(name).isNotNull())
    raise ConfigError(f"no strategy {strategy!r}")


def rows(df: DataFrame, names: Sequence[str] | None = None, order: Sequence[SortKey] = ()) -> DataFrame:
    """One row for each different value of the named columns, with all columns: the first in the given order, or any."""
    names = list(names or df.columns)
    need(df, *names)
    if not order:
        return df.dropDuplicates(names)
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*columns_of(df, order)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def account(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, different (rows over the named columns) and share, the different part of all; 0 of an empty table."""
    names = list(names or df.columns)
    need(df, *names)
    counts = df.groupBy(*names).agg(F.count("*").alias("_n"))
    made = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("different"))
    return made.select("rows", "different", F.coalesce(F.try_divide("different", "rows"), F.lit(0.0)).alias("share"))


def sketches(df: DataFrame, name: str, within: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """A HyperLogLog sketch of a column's values for each group, to be kept and merged."""
    need(df, name, *within)
    return df.where(F.col(name).isNotNull()).groupBy(*within).agg(F.hll_sketch_agg(F.xxhash64(name), F.lit(precision)).alias("sketch"))


def merged_count(kept: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Different values of all the sketches together, or of those of each group."""
    made = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")
    return kept.groupBy(*within).agg(made) if within else kept.agg(made)


def count_values(df: DataFrame, name: str, exact: bool = True, precision: int = PRECISION) -> DataFrame:
    """One row: how many different values a column has without null, exactly or by a HyperLogLog sketch of 2**precision registers."""
    need(df, name)
    if not 4 <= precision <= 21:
        raise ConfigError("precision is 4 to 21")
    made = F.count_distinct(name) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(name), F.lit(precision)))
    return df.where(F.col(name).isNotNull()).agg(made.alias("n"))

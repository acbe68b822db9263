"""Set operations over tables with the same columns and types in the same order; nulls are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import SchemaError, TypeMismatch
from sparkloom.operators.sorting import SortKey, order_by
from sparkloom.schema import logical


def check_alike(left: DataFrame, right: DataFrame) -> None:
    """Spark would match by position and convert."""
    if left.columns != right.columns:
        raise SchemaError(f"columns differ: {left.columns} and {right.columns}")
    for a, b in zip(left.schema.fields, right.schema.fields):
        if logical(a.dataType) != logical(b.dataType):
            raise TypeMismatch(f"{a.name} is {logical(a.dataType)} and {logical(b.dataType)}")


def _ordered(df: DataFrame, ordered: bool) -> DataFrame:
    return order_by(df, [SortKey(c) for c in df.columns]) if ordered else df


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    check_alike(left, right)
    return left.unionAll(right)


def union(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """Different rows of either; ordered sorts by all columns, nulls last."""
    check_alike(left, right)
    return _ordered(left.union(right).distinct(), ordered)


def intersect(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    check_alike(left, right)
    return _ordered(left.intersect(right), ordered)


def difference(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """Different rows of left that right doesn't have."""
    check_alike(left, right)
    return _ordered(left.subtract(right), ordered)


def account(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of what the operations make: rows (of union_all), in_either (union), in_both (intersect), in_left_only (difference), duplicates (rows that union leaves out) and
    their share. One shuffle, of both tables' partial counts."""
    check_alike(left, right)
    names = left.columns
    sides = left.withColumn("_left", F.lit(1)).unionAll(right.withColumn("_left", F.lit(0)))
    counts = sides.groupBy(*names).agg(F.sum("_left").alias("_l"), F.sum(1 - F.col("_left")).alias("_r"))
    made = counts.agg(
        F.coalesce(F.sum(F.col("_l") + F.col("_r")), F.lit(0)).alias("rows"), F.count("*").alias("in_either"), F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("in_both"), F.count_if(F.col("_r") == 0).alias("in_left_only")
    )
    made = made.withColumn("duplicates", F.col("rows") - F.col("in_either"))
    return made.withColumn("share", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)))


def distinct(df: DataFrame, ordered: bool = False) -> DataFrame:
    return _ordered(df.distinct(), ordered)

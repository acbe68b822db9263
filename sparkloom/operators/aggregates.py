"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, TypeMismatch
from sparkloom.schema import NUMERIC, distinct_names, logical_of, need

FUNCTIONS = ("count_star", "count", "sum", "mean", "min", "max", "any", "all")


@dataclass(frozen=True)
class Aggregate:
    """name: of the result; source: the column, none for count_star."""

    name: str
    function: str
    source: str | None = None

    def column(self, df: DataFrame) -> Column:
        if self.function not in FUNCTIONS:
            raise ConfigError(f"no aggregate {self.function!r}; there are {', '.join(FUNCTIONS)}")
        if self.function == "count_star":
            return F.count(F.lit(1)).alias(self.name)
        if self.source is None:
            raise ConfigError(f"{self.function} needs a column")
        kind = logical_of(df, self.source)
        c = F.col(self.source)
        if self.function in ("sum", "mean") and kind not in NUMERIC:
            raise TypeMismatch(f"{self.function} of {kind} column {self.source}")
        if self.function in ("any", "all") and kind not in (*NUMERIC, "boolean"):
            raise TypeMismatch(f"{self.function} of {kind} column {self.source}")
        made = {
            "count": F.count(c),
            "sum": F.sum(c),
            "mean": F.avg(c),
            "min": F.min(c),
            "max": F.max(c),
            "any": F.bool_or(c.cast("boolean")) if kind in (*NUMERIC, "boolean") else None,
            "all": F.bool_and(c.cast("boolean")) if kind in (*NUMERIC, "boolean") else None,
        }
        return made[self.function].alias(self.name)


def group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """One row a group, keys first; null is a key like any other. No keys: one row, also of an empty table. Partial sums are
    made before the shuffle."""
    if not aggregates:
        raise ConfigError("no aggregate")
    distinct_names([*keys, *[a.name for a in aggregates]])
    if keys:
        need(df, *keys)
    made = [a.column(df) for a in aggregates]
    return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)


def group_salted(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], salt: Column, parts: int = 32) -> DataFrame:
    """`group` for sums, counts, extremes, any and all in two rounds, by key and part first: for inputs whose rows of a key
    are already together, so that a task's partial sums don't shrink a hot key. salt: what to deal the rows of a key by."""
    again = {"count_star": F.sum, "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "any": F.bool_or, "all": F.bool_and}
    if any(a.function not in again for a in aggregates):
        raise ConfigError("a mean isn't made of means; ask for sum and count")
    dealt = group(df.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(parts))), [*keys, "_part"], aggregates)
    made = [again[a.function](a.name).alias(a.name) for a in aggregates]
    return dealt.groupBy(*keys).agg(*made) if keys else dealt.agg(*made)

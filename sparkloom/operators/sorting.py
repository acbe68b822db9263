"""Sorts. Nulls come last in either direction unless a key says otherwise, which is not Spark's default."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError
from sparkloom.schema import need


@dataclass(frozen=True)
class SortKey:
    name: str
    descending: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def columns_of(df: DataFrame, keys: Sequence[SortKey]) -> list[Column]:
    if not keys:
        raise ConfigError("no sort key")
    need(df, *[k.name for k in keys])
    return [k.column() for k in keys]


def order_by(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """A total sort: range partitions, each sorted, spilling as needed. Rows with equal keys have no order of their own."""
    return df.orderBy(*columns_of(df, keys))


def top_k(df: DataFrame, keys: Sequence[SortKey], k: int) -> DataFrame:
    """The first k rows: each task keeps k, no full sort."""
    if k < 0:
        raise ConfigError(f"no first {k} rows")
    return order_by(df, keys).limit(k)


def limit(df: DataFrame, count: int | None, offset: int = 0) -> DataFrame:
    """count rows after offset, all of them for None; of an unsorted table any rows."""
    if offset < 0 or (count is not None and count < 0):
        raise ConfigError("limit and offset can't be negative")
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)

"""Window functions. Nulls are one partition; order keys put them last; running frames count rows, not peers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, SchemaError, TypeMismatch
from sparkloom.operators.sorting import SortKey, columns_of
from sparkloom.schema import NUMERIC, distinct_names, logical_of, need

FUNCTIONS = ("row_number", "rank", "dense_rank", "running_sum", "running_max", "lag", "lead")


@dataclass(frozen=True)
class Window:
    name: str
    function: str
    source: str | None = None
    partition: Sequence[str] = ()
    order: Sequence[SortKey] = field(default_factory=tuple)
    offset: int = 1

    def column(self, df: DataFrame) -> Column:
        if self.function not in FUNCTIONS:
            raise ConfigError(f"no window function {self.function!r}; there are {', '.join(FUNCTIONS)}")
        if self.offset < 1:
            raise ConfigError("the offset is 1 at least")
        if self.partition:
            need(df, *self.partition)
        # without an order, rows are numbered as they come
        order = [F.lit(0)] if self.function == "row_number" and not self.order else columns_of(df, self.order)
        over = W.partitionBy(*self.partition).orderBy(*order)
        if self.function in ("row_number", "rank", "dense_rank"):
            return getattr(F, self.function)().over(over).cast("long")
        if self.source is None:
            raise ConfigError(f"{self.function} needs a column")
        need(df, self.source)
        if self.function in ("lag", "lead"):
            return getattr(F, self.function)(self.source, self.offset).over(over)
        if logical_of(df, self.source) not in NUMERIC:
            raise TypeMismatch(f"{self.function} of {logical_of(df, self.source)} column {self.source}")
        made = F.sum if self.function == "running_sum" else F.max
        return made(F.col(self.source).cast("double")).over(over.rowsBetween(W.unboundedPreceding, W.currentRow))


def apply(df: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """df and a column for each window, all over df as it is. Windows with equal partitions and order share one shuffle and sort."""
    for name in distinct_names([w.name for w in windows]):
        if name in df.columns:
            raise SchemaError(f"{name} is there already")
    return df.select("*", *[w.column(df).alias(w.name) for w in windows])

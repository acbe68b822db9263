"""Chains of table transformations, over a finite table or over a stream of the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame

from sparkloom.errors import ConfigError, PlanError
from sparkloom.operators.aggregates import Aggregate, group
from sparkloom.operators.rows import keep, narrow
from sparkloom.operators.sorting import SortKey, order_by

KINDS = ("streaming", "blocking", "accumulating")


@dataclass(frozen=True)
class Stage:
    """kind: row by row, over all rows at once, or by running totals."""

    name: str
    kind: str
    apply: Callable[[DataFrame], DataFrame]

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ConfigError(f"no kind {self.kind!r}; there are {', '.join(KINDS)}")


def filter_stage(predicate: Column) -> Stage:
    return Stage("filter", "streaming", lambda df: keep(df, predicate))


def project_stage(names: Sequence[str]) -> Stage:
    return Stage("project", "streaming", lambda df: narrow(df, names))


def sort_stage(keys: Sequence[SortKey]) -> Stage:
    return Stage("sort", "blocking", lambda df: order_by(df, keys))


def aggregate_stage(keys: Sequence[str], aggregates: Sequence[Aggregate]) -> Stage:
    return Stage("aggregate", "accumulating", lambda df: group(df, keys, aggregates))


def run(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """The stages in turn, as one lazy query: stages of the streaming kind share a Spark stage with the scan. On a
    streaming DataFrame a blocking stage is refused."""
    if df.isStreaming and any(s.kind == "blocking" for s in stages):
        raise PlanError(f"a stream has no end to wait for: {[s.name for s in stages if s.kind == 'blocking']}")
    return reduce(lambda d, s: d.transform(s.apply), stages, df)


def by_batches(df: DataFrame, stages: Sequence[Stage], sink: str, checkpoint: str, mode: str = "append"):
    """Run a streaming DataFrame through the stages over all rows that are there now, into Parquet files or, for totals, batch
    after batch. Returns the ended query."""
    out = run(df, stages)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).start()
    query.awaitTermination()
    return query

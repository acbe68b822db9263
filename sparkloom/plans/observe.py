"""What a query read and made, counted while it runs, and which strategies Spark chose for it."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.errors import BudgetExceeded


@dataclass
class Meter:
    """Rows that passed each named point of a query. Fill it by running an action on what `watch` returned."""

    points: dict[str, Observation] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        """df, counted as it flows by; costs no job of its own."""
        self.points[name] = Observation(name)
        self.widths[name] = len(df.columns)
        return df.observe(self.points[name], F.count(F.lit(1)).alias("rows"))

    def rows(self, name: str) -> int:
        return self.points[name].get["rows"]

    def values(self, name: str) -> int:
        """Rows times columns at the point."""
        return self.rows(name) * self.widths[name]

    def check(self, limits: Mapping[str, int]) -> None:
        """Refuses a point with more values than its limit."""
        for name, most in limits.items():
            if self.values(name) > most:
                raise BudgetExceeded(name, most, self.values(name))


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def strategies(df: DataFrame) -> list[str]:
    """Operators of the physical plan that were chosen among others, in the order of the plan."""
    names = "BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|HashAggregate|SortAggregate|ObjectHashAggregate|TakeOrderedAndProject|Sort|Window|Exchange|Generate"
    return re.findall(rf"\b({names})\b", executed_plan(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return [x.strip() for m in re.findall(r"PushedFilters: \[([^\]]*)\]", executed_plan(df)) for x in m.split(",") if x.strip()]


def read_columns(df: DataFrame) -> list[str]:
    return [x.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", executed_plan(df)) for x in m.split(",") if x]


def attribute(steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], source: DataFrame) -> dict[str, int]:
    """Values (rows times columns) that each step of a chain adds or takes away, from one run with a counter at every step."""
    meter, df = Meter(), source
    df = meter.watch(df, "source")
    for name, step in steps:
        df = meter.watch(step(df), name)
    df.write.format("noop").mode("overwrite").save()
    out, before = {"source": meter.values("source")}, meter.values("source")
    for name, _ in steps:
        out[name] = meter.values(name) - before
        before = meter.values(name)
    return out

"""Whether two tables hold the same rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agreement:
    """Truthy just if the tables agree."""

    same: bool
    reason: str = ""

    def __bool__(self) -> bool:
        return self.same


def agree(left: DataFrame, right: DataFrame, places: int = 9) -> Agreement:
    """Same column names, and each row as often on either side, in any order; floats to so many significant digits. Runs as
    a full join of row counts, so it works for tables of any size."""
    if sorted(left.columns) != sorted(right.columns):
        return Agreement(False, f"columns {left.columns} and {right.columns}")

    def rounded(df: DataFrame) -> DataFrame:
        out = []
        for n in sorted(df.columns):
            c = F.col(n)
            if df.schema[n].dataType.typeName() in ("float", "double"):
                c = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == math.inf), c.cast("string")).otherwise(F.format_string(f"%.{places - 1}e", (c + F.lit(0.0)).cast("double")))
            out.append(c.cast("string").alias(n))
        return df.select(*out).groupBy(*sorted(df.columns)).agg(F.count("*").alias("_n"))

    a, b = rounded(left), rounded(right)
    names = sorted(left.columns)
    met = a.alias("a").join(b.alias("b"), [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names], "full")
    bad = met.where(~F.col("a._n").eqNullSafe(F.col("b._n")))
    first = bad.limit(1).collect()
    return Agreement(True) if not first else Agreement(False, f"{bad.count()} different rows, such as {first[0].asDict()}")

"""Equi-joins of five kinds. A null key matches nothing. The right key is kept, and clashing names get a suffix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, TypeMismatch
from sparkloom.schema import joined_names, logical_of, need

#: Hints by strategy; None leaves the choice to Spark, which broadcasts a side only if its size is known to be small.
STRATEGIES = {None: None, "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}
NESTED_LOOP_PAIRS = 4_000_000


def _joined(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], kind: str, suffix: str, strategy: str | None) -> DataFrame:
    if not left_keys or len(left_keys) != len(right_keys):
        raise ConfigError("a join needs as many keys on the left as on the right, and one at least")
    if strategy not in STRATEGIES:
        raise ConfigError(f"no strategy {strategy!r}")
    need(left, *left_keys), need(right, *right_keys)
    for a, b in zip(left_keys, right_keys):
        if logical_of(left, a) != logical_of(right, b):
            raise TypeMismatch(f"{a} is {logical_of(left, a)}, {b} is {logical_of(right, b)}")
    if strategy == "nested_loop" and left.count() * right.count() > NESTED_LOOP_PAIRS:
        raise ConfigError(f"more than {NESTED_LOOP_PAIRS} pairs")
    names = joined_names(left.columns, right.columns, suffix)
    other = right.toDF(*names)
    if STRATEGIES[strategy]:
        other = other.hint(STRATEGIES[strategy])
    at = dict(zip(right.columns, names))
    return left.join(other, reduce(and_, [left[a] == other[at[b]] for a, b in zip(left_keys, right_keys)]), kind)


def inner_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], suffix: str = "_right", strategy: str | None = None) -> DataFrame:
    """Matching pairs: left's columns, then right's with its keys."""
    return _joined(left, right, left_keys, right_keys, "inner", suffix, strategy)


def left_outer(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Every left row, with nulls where nothing matches. A right outer join is this one with its sides exchanged."""
    return _joined(left, right, left_keys, right_keys, "left", suffix, None)


def full_outer(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Every row of both sides; an unmatched right row keeps its own values under their suffixed names."""
    return _joined(left, right, left_keys, right_keys, "full", suffix, None)


def semi(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Left rows that have a match, each as often as it stands there."""
    return _joined(left, right, left_keys, right_keys, "left_semi", "_right", None)


def anti(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Left rows without a match, those with a null key among them."""
    return _joined(left, right, left_keys, right_keys, "left_anti", "_right", None)


@dataclass(frozen=True)
class Fanout:
    """What a join on these keys makes, from key counts, without making it."""

    left_rows: int
    right_rows: int
    matched_left: int
    pairs: int

    @property
    def fanout(self) -> float:
        return self.pairs / self.left_rows if self.left_rows else 0.0


def fanout_counts(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """One row of left_rows, right_rows, matched_left and pairs of the inner join, and matched_keys of left_keys different ones of the left, by joining the counts of the keys."""
    a = left.groupBy(*left_keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_a{i}" for i, k in enumerate(left_keys)})
    b = right.groupBy(*right_keys).agg(F.count("*").alias("_m")).withColumnsRenamed({k: f"_b{i}" for i, k in enumerate(right_keys)})
    met = a.join(b, reduce(and_, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(left_keys))]), "full")
    both = F.col("_n").isNotNull() & F.col("_m").isNotNull()
    known = reduce(and_, [F.col(f"_a{i}").isNotNull() for i in range(len(left_keys))])
    sums = {"left_rows": F.sum("_n"), "right_rows": F.sum("_m"), "matched_left": F.sum(F.when(both, F.col("_n"))), "pairs": F.sum(F.col("_n") * F.col("_m")), "left_keys": F.count_if(known & F.col("_n").isNotNull()), "matched_keys": F.count_if(both)}
    return met.agg(*[F.coalesce(x, F.lit(0)).alias(n) for n, x in sums.items()])


def fanout(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> Fanout:
    """`fanout_counts` as numbers."""
    r = fanout_counts(left, right, left_keys, right_keys).first()
    return Fanout(*r[:4])

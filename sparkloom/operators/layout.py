"""Orders in which a table is cut into files, for what a later scan can skip."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError
from sparkloom.schema import need

ORDERS = ("arrival", "sorted", "clustered", "interleaved")
#: Ranks of 12 bits tell 4,096 stretches of a key apart; finer ones cost more to look up than any file count repays.
MOST_INTERLEAVED, RANK_BITS = 4, 12


def ranked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df and `_rank0`, `_rank1`, ... for the keys: how many of 4,095 quantiles are at most the value; 0 for null and NaN. Numbers, dates and times are ranked;
    quantiles take one pass for all keys and are looked up by binary search."""
    values = [(F.unix_date(k) if df.schema[k].dataType.typeName() == "date" else F.col(k)).cast("double") for k in keys]
    parts = 1 << RANK_BITS
    shares = F.from_json(F.lit(json.dumps([i / parts for i in range(1, parts)])), "array<double>")
    made = df.agg(*[F.to_json(F.percentile_approx(x, shares, 4 * parts)).alias(str(i)) for i, x in enumerate(values)]).first()
    for i, x in enumerate(values):
        cuts = sorted(set(json.loads(made[i] or "[]")))
        df = df.withColumn(f"_value{i}", F.when(~F.isnan(x), x))
        if len(cuts) < 2:
            df = df.withColumn(f"_rank{i}", F.lit(0).cast("long")).drop(f"_value{i}")
            continue
        search = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=f"_value{i}", outputCol=f"_rank{i}", handleInvalid="keep")
        found = F.when(F.col(f"_value{i}").isNull(), 0).otherwise(F.col(f"_rank{i}")).cast("long")
        df = search.transform(df).withColumn(f"_rank{i}", found).drop(f"_value{i}")
    return df


def morton(ranks: Sequence[str]) -> Column:
    """Bits of the ranks in turn, the highest first."""
    out = F.lit(0).cast("long")
    for i, r in enumerate(ranks):
        for b in range(RANK_BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(r), b).bitwiseAND(F.lit(1).cast("long")), b * len(ranks) + len(ranks) - 1 - i))
    return out


def arrange(df: DataFrame, order: str = "arrival", keys: Sequence[str] = (), files: int | None = None, rows_per_task: int = 0) -> DataFrame:
    """df in partitions that a write turns into files: as it comes; in ranges of the keys, sorted inside; with equal keys together,
    sorted inside; or in ranges of the keys' interleaved ranks, for predicates on any of them. With rows_per_task there are more than `files` partitions where
    the rows, which are counted, would otherwise be more than that in one; only equal keys stay together then."""
    if order not in ORDERS:
        raise ConfigError(f"no order {order!r}; there are {', '.join(ORDERS)}")
    if order == "arrival":
        return df if files is None else df.repartition(files)
    if not keys:
        raise ConfigError(f"{order} needs keys")
    need(df, *keys)
    if files is not None and rows_per_task:
        files = max(files, math.ceil(df.count() / rows_per_task))
    count = [] if files is None else [files]
    if order == "sorted":
        return df.repartitionByRange(*count, *keys).sortWithinPartitions(*keys)
    if order == "clustered":
        return df.repartition(*count, *keys).sortWithinPartitions(*keys)
    if len(keys) > MOST_INTERLEAVED:
        raise ConfigError(f"{MOST_INTERLEAVED} interleaved keys at most")
    names = [f"_rank{i}" for i in range(len(keys))]
    return ranked(df, keys).withColumn("_z", morton(names)).drop(*names).repartitionByRange(*count, "_z").sortWithinPartitions("_z").drop("_z")

"""Parquet tables: layouts on write, pruned scans, and an account of what a scan had to read.

Spark's reader skips row groups by their statistics and Bloom filters on its own, for SQL as well; the
account here comes from the file metadata column and an aggregate, so it works on any store that Spark reads."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, CorruptFile
from sparkloom.operators.layout import arrange
from sparkloom.operators.rows import keep
from sparkloom.schema import need


def write(df: DataFrame, path: str, order: str = "arrival", keys: Sequence[str] = (), files: int | None = None, rows_per_file: int = 0, bloom: Sequence[str] | Mapping[str, tuple[int, float]] = (), rows_per_task: int = 0) -> None:
    """A new table at path. order: arrival, sorted, clustered or interleaved by keys, in `files` files, or more by rows_per_task as `arrange` has it. bloom: columns that get Parquet Bloom filters, if wanted with the
    different values expected in a row group and the share of false positives, which size them."""
    writer = arrange(df, order, keys, files, rows_per_task).write
    for name in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{need(df, name)}", "true")
        if isinstance(bloom, Mapping):
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", bloom[name][0]).option(f"parquet.bloom.filter.fpp#{name}", bloom[name][1])
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def bloom_bytes(values: int, false_positives: float) -> int:
    """Size of a Bloom filter of so many values and that share of false positives."""
    if values < 1 or not 0 < false_positives < 1:
        raise ConfigError("a Bloom filter needs values and a share between 0 and 1")
    return math.ceil(-values * math.log(false_positives) / math.log(2) ** 2 / 8)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, unread but for its schema. What isn't Parquet is refused."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise CorruptFile(f"{path}: {e.getCondition() or e}") from e
    except Exception as e:
        raise CorruptFile(f"{path}: no Parquet table") from e


def scan(table: DataFrame, columns: Sequence[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Rows that satisfy the predicate, which may use columns that aren't asked for."""
    rows = table if predicate is None else keep(table, predicate)
    if columns is None:
        return rows
    need(table, *columns)
    return rows.select(*columns)


def batches(table: DataFrame, columns: Sequence[str] | None = None, predicate: Column | None = None) -> Iterator[Row]:
    """The scan's rows one partition after another; the driver holds two of them at a time."""
    return scan(table, columns, predicate).toLocalIterator(prefetchPartitions=True)


@dataclass(frozen=True)
class ScanReport:
    files: int
    files_needed: int
    bytes: int
    bytes_needed: int
    rows: int
    rows_in_needed: int
    rows_kept: int

    @property
    def skipped_share(self) -> float:
        return 1 - self.files_needed / self.files if self.files else 0.0

    @property
    def waste(self) -> float:
        """Share of the rows of needed files that the predicate rejects."""
        return 1 - self.rows_kept / self.rows_in_needed if self.rows_in_needed else 0.0


def report(table: DataFrame, predicate: Column) -> ScanReport:
    """How many files, bytes and rows hold rows that satisfy the predicate; one scan, a row per file."""
    of_file = table.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), F.coalesce(predicate, F.lit(False)).alias("k"))
    of_file = of_file.groupBy("f").agg(F.max("b").alias("b"), F.count("*").alias("n"), F.count_if("k").alias("k"))
    hit = F.col("k") > 0
    r = of_file.agg(*[F.coalesce(x, F.lit(0)) for x in (F.count("*"), F.count_if(hit), F.sum("b"), F.sum(F.when(hit, F.col("b"))), F.sum("n"), F.sum(F.when(hit, F.col("n"))), F.sum("k"))]).first()
    return ScanReport(*r)


def zone_map(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Least and greatest value, nulls and rows of each file, per column: file, column_name, low, high (as text), nulls, rows."""
    need(table, *names)
    made = [x for n in names for x in (F.min(n).cast("string").alias(f"low_{n}"), F.max(n).cast("string").alias(f"high_{n}"), F.count_if(F.col(n).isNull()).alias(f"nulls_{n}"))]
    wide = table.select(F.col("_metadata.file_path").alias("file"), *names).groupBy("file").agg(F.count("*").alias("rows"), *made)
    return wide.select("file", "rows", F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"low_{n}").alias("low"), F.col(f"high_{n}").alias("high"), F.col(f"nulls_{n}").alias("nulls")) for n in names])).alias("z")).select("file", "z.*", "rows")


def footer_facts(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """One row of rows, and low_NAME and high_NAME for number columns, answered by the Parquet footers: Spark's second reader pushes the aggregates down, so no page is read.
    It is read while the settings that this takes hold, which then are as before."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        table = open_table(spark, path)
        need(table, *names)
        made = table.agg(F.count("*").alias("rows"), *[x for n in names for x in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"))])
        return spark.createDataFrame(made.collect(), made.schema)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files(table: DataFrame) -> DataFrame:
    """file, bytes and rows of each part of a table."""
    return table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))


#: Bytes that opening a file costs as much as reading.
OPEN_BYTES = 4096


@dataclass(frozen=True)
class Compaction:
    files_before: int
    files_after: int
    bytes_before: int
    bytes_after: int

    @property
    def rewrite_bytes(self) -> int:
        return self.bytes_before + self.bytes_after

    @property
    def saved_per_scan(self) -> int:
        return (self.files_before - self.files_after) * OPEN_BYTES + self.bytes_before - self.bytes_after

    @property
    def break_even(self) -> float:
        """Scans after which the rewrite has paid."""
        return self.rewrite_bytes / self.saved_per_scan if self.saved_per_scan > 0 else float("inf")


def ingest(df: DataFrame, path: str, rows: int) -> None:
    """Append df to the table at path in files of `rows` rows at most."""
    if rows < 1:
        raise ConfigError("a file holds one row at least")
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def compact(spark: SparkSession, path: str, target: str, bytes_per_file: int = 128 << 20, order: str = "arrival", keys: Sequence[str] = ()) -> Compaction:
    """Rewrite the table at path into target in files of about the given size. The old files stay until the caller swaps the tables."""
    table = open_table(spark, path)
    before = files(table).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, round(before[1] / bytes_per_file))
    if order == "arrival":
        table.coalesce(parts).write.parquet(target)
    else:
        write(table, target, order, keys, parts)
    after = files(open_table(spark, target)).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return Compaction(before[0], after[0], before[1], after[1])

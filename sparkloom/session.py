"""Where tables that belong to one query are kept between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may fall back to a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Folders that this process has asked for and not removed.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/sparkloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written() -> int:
    """How many folders there are now, for `discard` to start from."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Remove the folders asked for since then, but for one that is named `keep`. DataFrames that read them can't be used any more."""
    for path in [p for p in _written[since:] if not keep or f"/sparkloom/{keep}-" not in p]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

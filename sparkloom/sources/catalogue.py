"""Named Parquet tables with statistics that know when they are stale."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import ConfigError, DataError, SchemaError
from sparkloom.sources.parquet import files, open_table
from sparkloom.statistics.tables import TableStatistics, collect

#: Growth of a table from which its statistics are stale.
GROWTH = 0.2
FORMAT = "format int, name string, path string, statistics string"


@dataclass
class Entry:
    path: str
    table: DataFrame
    rows: int
    statistics: TableStatistics | None = None

    def stale(self, growth: float = GROWTH) -> bool:
        return self.statistics is None or abs(self.rows - self.statistics.rows) > growth * max(self.statistics.rows, 1)


@dataclass
class Catalogue:
    spark: SparkSession
    entries: dict[str, Entry] = field(default_factory=dict)

    def add(self, name: str, path: str) -> None:
        """Register a table, also as a view for SQL. A name that is taken is refused."""
        if name in self.entries:
            raise SchemaError(f"there is a table {name} already")
        table = open_table(self.spark, path)
        self.entries[name] = Entry(path, table, table.count())  # a count that Parquet footers answer
        table.createOrReplaceTempView(name)

    def open_all(self, folder: str, names: list[str]) -> None:
        for name in names:
            self.add(name, f"{folder}/{name}.parquet")

    def entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise ConfigError(f"no table {name}; there are {', '.join(self.entries) or 'none'}")
        return self.entries[name]

    def table(self, name: str) -> DataFrame:
        return self.entry(name).table

    def refresh(self, name: str) -> None:
        """See the files that are there now."""
        e = self.entry(name)
        self.spark.catalog.refreshByPath(e.path)
        e.table = open_table(self.spark, e.path)
        e.rows = e.table.count()
        e.table.createOrReplaceTempView(name)

    def analyse(self, name: str, growth: float = GROWTH) -> TableStatistics:
        """Statistics of a table, taken anew if they are stale."""
        e = self.entry(name)
        if e.stale(growth):
            e.statistics = collect(e.table)
        return e.statistics

    def analyse_all(self) -> dict[str, TableStatistics]:
        return {name: self.analyse(name) for name in self.entries}

    def size(self, name: str) -> int:
        return files(self.table(name)).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def save(self, path: str) -> None:
        """Names, paths and statistics as one JSON file."""
        rows = [(2, n, e.path, e.statistics and json.dumps(asdict(e.statistics))) for n, e in self.entries.items()]
        self.spark.createDataFrame(rows, FORMAT).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalogue:
        """The saved tables, with their statistics, which are stale if the files have grown since."""
        rows = spark.read.schema(FORMAT).json(path).orderBy("name").collect()
        if any(r["format"] not in (1, 2) for r in rows):
            raise DataError(f"{path}: not a catalogue of format 1 or 2")
        made = cls(spark)
        for r in rows:
            made.add(r["name"], r["path"])
            if r["statistics"]:
                made.entries[r["name"]].statistics = TableStatistics.of(json.loads(r["statistics"]))
        return made

"""SQL over named tables. Spark parses, plans and runs it; refusals come as this library's errors."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from sparkloom.errors import PlanError, SchemaError, UnknownColumn


class SqlError(PlanError):
    """The text isn't SQL. line and column: where, if known, from 1 and 0."""

    def __init__(self, message: str, line: int | None, column: int | None):
        super().__init__(message)
        self.line, self.column = line, column


def query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of a SELECT over the given tables, views and catalogue tables."""
    if not re.match(r"\s*(--[^\n]*\n\s*)*(select|with|values|table|from|\()", text, re.IGNORECASE):
        raise PlanError("only queries are run here")
    try:
        return spark.sql(text, **tables) if tables else spark.sql(text)
    except ParseException as e:
        at = re.search(r"line (\d+), pos (\d+)", str(e))
        raise SqlError(str(e).split("\n")[0], *(int(x) for x in at.groups()) if at else (None, None)) from e
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            p = e.getMessageParameters() or {}
            raise UnknownColumn(p.get("objectName", "?").strip("`"), re.findall(r"`([^`.]+)`(?:,|$)", p.get("proposal", ""))) from e
        raise SchemaError(str(e).split("\n")[0]) from e


def explain(df: DataFrame) -> str:
    """The formatted physical plan, without running it."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

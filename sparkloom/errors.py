"""Refusals. They are raised from schemas, before Spark runs a job."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all refusals."""


class SchemaError(EngineError):
    """The columns don't fit the request."""


class TypeMismatch(SchemaError):
    """A column has the wrong type."""


class UnknownColumn(SchemaError):
    """No such column; names those that there are."""

    def __init__(self, name: str, known: list[str]):
        super().__init__(f"no column {name!r}; there are {', '.join(known) or 'none'}")
        self.name, self.known = name, known


class DataError(EngineError):
    """Values can't be converted or read."""


class CorruptFile(DataError):
    """Files that can't be read as Parquet."""


class PlanError(EngineError):
    """The request makes no query."""


class ConfigError(EngineError):
    """A parameter has a value that isn't allowed."""


class BudgetExceeded(EngineError):
    """A measured quantity is above its ceiling."""

    def __init__(self, kind: str, limit: float, reached: float):
        super().__init__(f"{kind}: {reached} is over the limit of {limit}")
        self.kind, self.limit, self.reached = kind, limit, reached

    @property
    def overrun(self) -> float:
        return self.reached - self.limit

"""python -m sparkloom.cli COMMAND --table NAME=PATH ...: schema, stats, explain, query, write, files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from sparkloom.errors import ConfigError, EngineError
from sparkloom.plans.sql import explain, query
from sparkloom.sources.catalogue import Catalogue
from sparkloom.sources.parquet import files, write


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("command", choices=["schema", "stats", "explain", "query", "write", "files"])
    p.add_argument("sql", nargs="?", default="")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--to")
    p.add_argument("--order", default="arrival")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--json", action="store_true")
    return p


def _answer(spark: SparkSession, args: argparse.Namespace):
    catalogue = Catalogue(spark)
    for pair in args.table:
        name, _, path = pair.partition("=")
        if not path:
            raise ConfigError(f"--table takes NAME=PATH, not {pair!r}")
        catalogue.add(name, path)
    if args.command == "schema":
        return {n: e.table.schema.jsonValue()["fields"] for n, e in catalogue.entries.items()}
    if args.command == "stats":
        return {n: {c: {"kind": s.kind, "rows": s.rows, "nulls": s.nulls, "distinct": s.distinct} for c, s in t.columns.items()} for n, t in catalogue.analyse_all().items()}
    if args.command == "files":
        return {n: [r.asDict() for r in files(e.table).orderBy("file").collect()] for n, e in catalogue.entries.items()}
    df = query(spark, args.sql)
    if args.command == "explain":
        return explain(df)
    if args.command == "write":
        if not args.to:
            raise ConfigError("write needs --to")
        write(df, args.to, args.order, args.key)
        return {"written": args.to}
    return [r.asDict() for r in df.limit(args.limit).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 2 for a refusal."""
    args = parser().parse_args(argv)
    try:
        found = _answer(spark or SparkSession.builder.getOrCreate(), args)
    except EngineError as e:
        print(json.dumps({"error": str(e)}) if args.json else f"error: {e}", file=sys.stderr)
        return 2
    print(found if isinstance(found, str) and not args.json else json.dumps(found, indent=None if args.json else 1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

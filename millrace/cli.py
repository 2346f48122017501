"""python -m millrace.cli "<sql>" [--csv NAME=PATH] [--json NAME=PATH] [--parquet NAME=PATH] [--format F] [--stats] [--notablescan]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import Observation, SparkSession

from . import sources
from .catalog import Catalog
from .engine import Engine
from .errors import NoTableScanError, ParseError, ShardKeyUpdateError, ShardLockedError, UnsupportedQueryError


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("sql")
    for kind in ("csv", "json", "parquet"):
        p.add_argument(f"--{kind}", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--index", action="append", default=[], metavar="TABLE:NAME=COLUMN,...")
    p.add_argument("--root", help="folder for the versions of tables that change")
    p.add_argument("--format", default="default", choices=["default", "json", "pretty"])
    p.add_argument("--stats", action="store_true")
    p.add_argument("--notablescan", action="store_true")
    said, out = p.parse_args(args), out or sys.stdout
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    catalog = Catalog(spark, said.root)
    for kind, read in (("csv", catalog.import_csv), ("json", catalog.import_json), ("parquet", catalog.import_parquet)):
        for item in getattr(said, kind):
            read(*item.split("=", 1))
    for item in said.index:
        (table, name), keys = item.split("=", 1)[0].split(":"), item.split("=", 1)[1].split(",")
        catalog.create_index(table, name, keys)
    seen = Observation("scan") if said.stats else None
    try:
        result = Engine(spark, catalog).query(said.sql, notablescan=said.notablescan, observe=seen)
        for line in sources.show((r.asDict(recursive=True) for r in result.toLocalIterator()), said.format):
            print(line, file=out)
    except (ParseError, NoTableScanError, UnsupportedQueryError, ShardKeyUpdateError, ShardLockedError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if said.stats:
        print(json.dumps(seen.get if said.sql.strip()[:6].lower() == "select" and " from " in said.sql.lower() else {}), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Queries of the dialect over a catalog."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import dialect as d
from . import sources
from .catalog import Catalog
from .errors import NoTableScanError, UnsupportedQueryError
from .functions import AGGREGATES
from .plans import access
from .plans.expressions import filtered, lower
from .plans.select import aggregates, select


class Engine:
    """strict: nulls in sum, max and avg are errors instead of being skipped."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, strict: bool = False):
        self.spark, self.catalog, self.strict = spark, catalog or Catalog(spark), strict

    def query(self, sql: str, *, notablescan: bool = False, stdin: Iterable[str] | None = None, observe: Observation | None = None) -> DataFrame:
        """The result of a query. SELECT is lazy; statements that change tables run at once and return their count.

        observe: gets what a SELECT read when the result has been computed: table_tuples_scanned, or
        index_tuples_fetched where an index serves the query, and backend_requests, the replica sets asked."""
        query = d.parse(sql)
        if query.options.get("explain"):
            return self.spark.createDataFrame([(json.dumps(self.explain(query)),)], "explain string")
        if notablescan:
            self.check_scan(query)
        return self.run(query, stdin, observe)

    def explain(self, query: d.Query | str):
        """The nested list of operators."""
        query = d.parse(query) if isinstance(query, str) else query
        table = getattr(query, "table", None)
        agg = aggregates(query) if isinstance(query, d.Select) else []
        return access.explain(query, self.catalog.indexes_for(table) if table else {}, agg[0][1].name if agg else None)

    def check_scan(self, query: d.Query) -> None:
        plan = json.dumps(self.explain(query))
        if '"TableScan"' in plan:
            raise NoTableScanError(f"no index of {query.table} serves this query")

    def run(self, query: d.Query, stdin: Iterable[str] | None = None, observe: Observation | None = None) -> DataFrame:
        cat = self.catalog
        if isinstance(query, d.Select):
            source = None if query.table is None else cat.visible(query.table, query.where)
            if source is not None and observe is not None:
                source = self._observed(query, source, observe)
            return select(query, source, self.spark, self.strict)
        if isinstance(query, d.Insert):
            return self._count(self._add(query.table, sources.rows_frame(self.spark, query.keys, [[self._constant(x) for x in row] for row in query.rows])))
        if isinstance(query, d.Copy):
            rows = sources.read_lines(self.spark, sys.stdin if stdin is None else stdin) if query.path is None else sources.read_json(self.spark, query.path)
            return self._count(self._add(query.table, rows))
        if isinstance(query, d.ReshardMove):
            if query.table not in cat.shards:
                raise UnsupportedQueryError(f"{query.table} has no shards")
            return self._count(cat.reshard(query.table, query.shard, query.target))
        shards = cat.shards.get(query.table)
        if shards:
            shards.check(shards.matching(query.where))
        if isinstance(query, d.Update):
            if shards:
                shards.check_update([name for name, _ in query.assignments])
            return self._count(cat.update(query.table, query.assignments, query.where))
        return self._count(cat.delete(query.table, query.where))

    def _observed(self, query: d.Select, source: DataFrame, observe: Observation) -> DataFrame:
        indexes = self.catalog.indexes_for(query.table)
        path = next(iter(access.paths(indexes, query.where, [] if aggregates(query) else query.order_by)), None)
        if path is not None:
            source = filtered(path.covered, source)
        n, zero = F.count(F.lit(1)), F.lit(0).cast("long")
        asked = F.max(F.lit(self.catalog.backends(query.table, query.where)).cast("long"))
        return source.observe(observe, (zero if path else n).alias("table_tuples_scanned"), (n if path else zero).alias("index_tuples_fetched"), F.coalesce(asked, zero).alias("backend_requests"))

    def _add(self, name: str, rows: DataFrame) -> int:
        if name in self.catalog.shards:
            self.catalog.shards[name].check(None)
        return self.catalog.insert(name, rows)

    def _constant(self, expr: d.Expr):
        if isinstance(expr, d.Literal):
            return expr.value
        if isinstance(expr, d.Call) and expr.name in AGGREGATES:
            raise UnsupportedQueryError("an aggregate isn't a value")
        one = self.spark.range(1).select()
        return one.select(lower(expr, one).alias("x")).first()["x"]

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

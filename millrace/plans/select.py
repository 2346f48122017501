"""SELECT as DataFrame operations.

Plain: scan, filter, sort, limit, project, so ORDER BY sees the table's columns. Grouped: scan,
filter, aggregate, sort, limit, so ORDER BY sees group keys and aliases. Partial aggregation,
top-k, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import dialect as d
from ..functions import AGGREGATES
from .expressions import filtered, kind_of, lower


def aggregates(query: d.Select) -> list[tuple[str, d.Call]]:
    return [(k, x) for k, x in query.items if isinstance(x, d.Call) and x.name in AGGREGATES]


def _sorted(df: DataFrame, order_by: list[d.Order], columns) -> DataFrame:
    keys = [(c.desc_nulls_last() if o.descending else c.asc_nulls_last()) for o, c in zip(order_by, columns, strict=True)]
    return df.orderBy(*keys) if keys else df


def select(query: d.Select, source: DataFrame | None, spark: SparkSession, strict: bool = False) -> DataFrame:
    df = spark.range(1).select() if source is None else source
    df = filtered(query.where, df)
    agg = aggregates(query)
    if agg or query.group_by:
        return _grouped(query, df, agg, strict)
    if source is not None:
        df = _sorted(df, query.order_by, [lower(o.expr, df) for o in query.order_by])
        df = df if query.limit is None else df.limit(query.limit)
    return df.select(*projection(query.items, df))


def projection(items: list[tuple[str, d.Expr]], df: DataFrame) -> list:
    """The select list; * stands for all columns, and an item of a column's name takes its place."""
    own = {k: lower(x, df).alias(k) for k, x in items if x != d.Column("*")}
    if len(own) == len(items):
        return list(own.values())
    table = {c: df[f"`{c}`"] for c in df.columns if c != "_tid"}
    return list((table | own).values())


def _grouped(query: d.Select, df: DataFrame, agg: list[tuple[str, d.Call]], strict: bool) -> DataFrame:
    """Keys that aren't selected are grouped by and not returned; other items that are neither key nor aggregate are left out."""
    calls = []
    for k, x in agg:
        value = lower(x.args[0], df) if x.args[0] != d.Column("*") else lower(d.Literal(1), df)
        calls.append(AGGREGATES[x.name](value, kind_of(df, value), strict).alias(k))
    if not query.group_by:
        return df.agg(*calls)
    names = [f"__key{i}" for i in range(len(query.group_by))]
    keys = [lower(x, df).alias(n) for x, n in zip(query.group_by, names, strict=True)]
    out = df.groupBy(*keys).agg(*calls) if calls else df.select(*keys).distinct()
    place = dict(zip(query.group_by, names, strict=True))
    shown = {k: place[x] for k, x in query.items if x in place} | {k: k for k, _ in agg}
    # What ORDER BY may name: selected aliases first, then the keys' own columns.
    aliased = out.select("*", *[out[n].alias(k) for k, n in shown.items() if n != k])
    more = {x.name: place[x] for x in query.group_by if isinstance(x, d.Column) and x.name not in aliased.columns}
    aliased = aliased.select("*", *[aliased[n].alias(k) for k, n in more.items()])
    aliased = _sorted(aliased, query.order_by, [aliased[place[o.expr]] if o.expr in place else lower(o.expr, aliased) for o in query.order_by])
    aliased = aliased if query.limit is None else aliased.limit(query.limit)
    return aliased.select(*[k for k, _ in query.items if k in shown])

"""Operators that work on DataFrames and catalog tables without the dialect."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The sum of the counts that statements on several shards return."""
    return append(*parts).agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("count"))


def without_tid(df: DataFrame) -> DataFrame:
    return df.drop("_tid")


def key_condition(keys: list[Column], sargs: dict[str, list]) -> Column | None:
    """Search arguments of an index as a predicate: eq (all keys or the first), in (a list of
    such), and gt, gte, lt, lte, whose values before the last are equalities."""
    equal = lambda values: reduce(and_, [k.eqNullSafe(F.lit(v)) for k, v in zip(keys, values, strict=False)])
    parts = []
    for op, values in sargs.items():
        if op == "eq":
            parts += [equal(values)] if values else []
        elif op == "in":
            parts.append(reduce(or_, [equal(v) for v in values], F.lit(False)))
        else:
            *before, value = values
            at = keys[len(before)]
            parts += [equal(before)] if before else []
            parts.append({"gt": at > value, "gte": at >= value, "lt": at < value, "lte": at <= value}[op])
    return reduce(and_, parts) if parts else None

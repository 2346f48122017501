"""Expressions of the dialect as Spark columns.

Equality is two-valued: null equals null and differs from everything else. Values of different
kinds are never equal, and no order holds between them. Where a condition is wanted, a value
that isn't a boolean counts as true unless it is null. Unknown columns are null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dialect as d
from ..errors import UnsupportedQueryError
from ..functions import AGGREGATES, scalar


def kind_of(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias("x")).schema[0].dataType


def family(kind: T.DataType) -> str:
    """Types whose values compare with each other."""
    return "number" if isinstance(kind, T.NumericType) else "null" if isinstance(kind, T.NullType) else kind.typeName()


def lower(expr: d.Expr, df: DataFrame) -> Column:
    """The value of an expression over the rows of df."""
    if isinstance(expr, d.Literal):
        return F.lit(expr.value)
    if isinstance(expr, d.Column):
        return df[f"`{expr.name}`"] if expr.name in df.columns else F.lit(None)
    if isinstance(expr, d.Call):
        if expr.name in AGGREGATES:
            raise UnsupportedQueryError(f"{expr.name} isn't a scalar function")
        return scalar(expr.name, [lower(a, df) for a in expr.args])
    if isinstance(expr, d.Logic):
        left, right = truth(expr.left, df), truth(expr.right, df)
        return left & right if expr.op == "AND" else left | right
    if isinstance(expr, d.In):
        return reduce(lambda a, b: a | b, [_equal(expr.expr, v, df) for v in expr.values])
    if expr.op == "=":
        return _equal(expr.left, expr.right, df)
    if expr.op == "<>":
        return ~_equal(expr.left, expr.right, df)
    left, right = lower(expr.left, df), lower(expr.right, df)
    one, other = family(kind_of(df, left)), family(kind_of(df, right))
    if one != other or one == "boolean" or "null" in (one, other):
        return F.lit(None).cast("boolean")
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[expr.op]


def _equal(left: d.Expr, right: d.Expr, df: DataFrame) -> Column:
    a, b = lower(left, df), lower(right, df)
    if family(kind_of(df, a)) != family(kind_of(df, b)):
        return a.isNull() & b.isNull()
    return a.eqNullSafe(b)


def truth(expr: d.Expr, df: DataFrame) -> Column:
    """Whether a condition holds: never null."""
    value = lower(expr, df)
    if not isinstance(kind_of(df, value), T.BooleanType):
        return value.isNotNull()
    never_null = isinstance(expr, d.Logic | d.In) or isinstance(expr, d.Compare) and expr.op in ("=", "<>")
    return value if never_null else F.coalesce(value, F.lit(False)) if isinstance(expr, d.Column | d.Literal | d.Call) else value


def all_true(where: list[d.Expr], df: DataFrame) -> Column | None:
    return reduce(and_, [truth(x, df) for x in where]) if where else None


def filtered(where: list[d.Expr], df: DataFrame) -> DataFrame:
    """Conditions reach the scan one by one, as Spark pushes them down."""
    for x in where:
        df = df.filter(truth(x, df))
    return df

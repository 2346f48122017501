"""Scalar functions and aggregates, by their names in the dialect."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedQueryError


def shard_of(value: object, n: int) -> int:
    """The shard of a key on the driver; hashmod gives the same for columns."""
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return crc32(text.encode()) % n


def hashmod(value: Column, n: Column) -> Column:
    return F.crc32(F.coalesce(value.cast("string"), F.lit(""))) % n


#: Name to a function from columns to a column.
SCALARS: dict[str, Callable[..., Column]] = {"upper": F.upper, "hashmod": hashmod}


def register(name: str, function: Callable[..., Column]) -> None:
    """Adds a scalar function: anything from columns to a column, a pandas UDF too."""
    SCALARS[name] = function


def scalar(name: str, args: list[Column]) -> Column:
    if name not in SCALARS:
        raise UnsupportedQueryError(f"no function {name}")
    return SCALARS[name](*args)


def _number(kind: T.DataType, name: str) -> None:
    if not isinstance(kind, T.NumericType | T.NullType):
        raise UnsupportedQueryError(f"{name} of a {kind.simpleString()}")


def _checked(x: Column, name: str, strict: bool) -> Column:
    return F.when(x.isNull(), F.raise_error(F.lit(f"{name} of null"))).otherwise(x) if strict else x


def _zero(kind: T.DataType) -> Column:
    return F.lit(0.0) if isinstance(kind, T.FractionalType) else F.lit(0).cast("long")


def count(x: Column, kind: T.DataType, strict: bool) -> Column:
    """All rows: the argument doesn't matter."""
    return F.count(F.lit(1))


def sum_(x: Column, kind: T.DataType, strict: bool) -> Column:
    """0 for no rows; nulls are skipped, or an error if strict."""
    _number(kind, "sum")
    return _zero(kind) if isinstance(kind, T.NullType) else F.coalesce(F.sum(_checked(x, "sum", strict)), _zero(kind))


def max_(x: Column, kind: T.DataType, strict: bool) -> Column:
    """Never below 0, which is also the value for no rows."""
    _number(kind, "max")
    return _zero(kind) if isinstance(kind, T.NullType) else F.greatest(_zero(kind).cast(kind), F.max(_checked(x, "max", strict)))


def avg(x: Column, kind: T.DataType, strict: bool) -> Column:
    """Integers divide to the floor; 0 for no rows."""
    _number(kind, "avg")
    if isinstance(kind, T.NullType):
        return _zero(kind)
    x = _checked(x, "avg", strict)
    total, n = F.sum(x), F.nullif(F.count(x), F.lit(0).cast("long"))
    if isinstance(kind, T.FractionalType):
        return F.coalesce(total / n, F.lit(0.0))
    return F.coalesce(F.floor((total - F.pmod(total, n)) / n).cast("long"), F.lit(0).cast("long")) if not isinstance(kind, T.IntegralType) else F.coalesce(F.call_function("div", total - F.pmod(total, n), n), F.lit(0).cast("long"))


AGGREGATES: dict[str, Callable[[Column, T.DataType, bool], Column]] = {"count": count, "sum": sum_, "max": max_, "avg": avg}


def register_aggregate(name: str, function: Callable[[Column, T.DataType, bool], Column]) -> None:
    """Adds an aggregate: a column expression of built-in aggregates, so that Catalyst splits it into partial and final steps."""
    AGGREGATES[name] = function


def folded(init: object, reduce: Callable[[Column, Column], Column], render: Callable[[Column], Column], kind: str) -> Callable[[Column, T.DataType, bool], Column]:
    """An aggregate from a first state, a step (state, value) and a last step, for register_aggregate.

    The values of a group come together in one task, as the steps may depend on all before them:
    for groups that fit there. The order of values is that of their sort; nulls are skipped."""
    return lambda x, _, strict: F.aggregate(F.sort_array(F.collect_list(_checked(x, "aggregate", strict))), F.lit(init).cast(kind), reduce, render)

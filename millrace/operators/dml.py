"""Changes to tables by copy on write.

A change computes the table's next version from the current one; the catalog writes it to a
folder of its own and then moves the pointer, so a failed statement leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dialect as d
from ..errors import UnsupportedQueryError
from ..plans.expressions import all_true, family, kind_of, lower
from . import append


def inserted(table: DataFrame | None, rows: DataFrame) -> DataFrame:
    """New keys become columns of the table."""
    return rows if table is None or not table.columns else append(table, rows)


def updated(table: DataFrame, assignments: list[tuple[str, d.Expr]], where: list[d.Expr]) -> DataFrame:
    """Assignments run one after the other, so later ones see earlier ones; which rows change is settled before the first.
    A column keeps its kind of values."""
    hit = all_true(where, table)
    out = table.withColumn("__hit", F.lit(True) if hit is None else F.coalesce(hit, F.lit(False)))
    for name, expr in assignments:
        old = out[f"`{name}`"] if name in out.columns else F.lit(None)
        new = lower(expr, out)
        one, other = family(kind_of(out, old)), family(kind_of(out, new))
        if one != other and "null" not in (one, other):
            raise UnsupportedQueryError(f"{name} holds {one} values, not {other}")
        out = out.withColumn(name, F.when(F.col("__hit"), new).otherwise(old))
    return out.drop("__hit")


def matching(table: DataFrame, where: list[d.Expr]) -> int:
    hit = all_true(where, table)
    return table.count() if hit is None else table.filter(hit).count()


def deleted(table: DataFrame, where: list[d.Expr]) -> DataFrame:
    hit = all_true(where, table)
    return table.limit(0) if hit is None else table.filter(~F.coalesce(hit, F.lit(False)))

"""Reading and writing rows: CSV with a header, JSON lines, lines in memory, and result formats."""

from __future__ import annotations

import json
import pprint
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Without a schema numeric columns become numbers and everything else stays text, TRUE and FALSE too."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    found = reader.option("inferSchema", True).csv(path).schema
    number = lambda f: isinstance(f.dataType, T.NumericType)
    return reader.schema(T.StructType([T.StructField(f.name, f.dataType if number(f) else T.StringType()) for f in _widened(found)])).csv(path)


def _widened(schema: T.StructType) -> list[T.StructField]:
    """Integers as long."""
    return [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType) for f in schema]


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object a line; objects may differ in their keys."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """JSON lines from memory, such as standard input."""
    rows = [json.loads(x) for x in lines if x.strip()]
    keys = list(dict.fromkeys(k for r in rows for k in r))
    return rows_frame(spark, keys, [[r.get(k) for k in keys] for r in rows])


def _common_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    return T.StringType()


def rows_frame(spark: SparkSession, keys: list[str], rows: list[list]) -> DataFrame:
    """Literal rows: short ones are filled with null, what is too much is dropped, the last of equal keys counts."""
    full = [(r + [None] * len(keys))[: len(keys)] for r in rows]
    place = {k: i for i, k in enumerate(keys)}
    columns = {k: [r[i] for r in full] for k, i in place.items()}
    kinds = T.StructType([T.StructField(k, _common_type(v)) for k, v in columns.items()])
    as_kind = lambda v, k: v if v is None or not isinstance(k, T.StringType | T.DoubleType) else str(v) if isinstance(k, T.StringType) else float(v)
    return spark.createDataFrame([tuple(as_kind(columns[f.name][i], f.dataType) for f in kinds) for i in range(len(full))], kinds)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def show(rows: Iterable[dict], form: str = "default") -> Iterable[str]:
    """Result rows as text: default (a dict), json (an object), pretty."""
    make = {"default": repr, "json": lambda r: json.dumps(r, default=str), "pretty": lambda r: pprint.pformat(r, sort_dicts=False)}
    if form not in make:
        raise ValueError(f"no format {form}")
    return map(make[form], rows)

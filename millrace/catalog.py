"""Tables, indexes and shard maps by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialect as d
from . import sources
from .operators import dml, key_condition
from .operators.shards import LAYOUT, SHARD, Folders, Shards, pruned, with_shard, write_sharded, written
from .plans.expressions import lower
from .streaming import journal

#: Appended folders of a table before its rows are written together again.
MOST_FOLDERS = 32


class Catalog:
    """root: the shared folder for versions of tables that change. Tables that are only read need none."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.tables: dict[str, DataFrame | None] = {}
        self.indexes: dict[str, dict[str, list[d.Order]]] = {}
        self.shards: dict[str, Shards] = {}
        self.folders: dict[str, Folders] = {}
        self.appended: dict[str, int] = {}

    # Tables

    def create_table(self, name: str, df: DataFrame | None = None) -> None:
        self.tables[name] = df
        self.indexes.setdefault(name, {})

    def table(self, name: str) -> DataFrame:
        """The rows of a table; without any yet, no rows and no columns."""
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        df = self.tables[name]
        return self.spark.range(0).select() if df is None else df

    table_scan = table

    def with_tids(self, name: str) -> DataFrame:
        """With _tid, which names a row within one version of the table."""
        return self.table(name).withColumn("_tid", F.monotonically_increasing_id())

    def fetch(self, name: str, tid: int) -> DataFrame:
        return self.with_tids(name).filter(F.col("_tid") == tid).drop("_tid")

    def import_csv(self, name: str, path: str, schema=None) -> None:
        self.create_table(name, sources.read_csv(self.spark, path, schema))

    def import_json(self, name: str, path: str, schema=None) -> None:
        self.create_table(name, sources.read_json(self.spark, path, schema))

    def import_parquet(self, name: str, path: str) -> None:
        self.create_table(name, self.spark.read.parquet(path))

    # Changes

    def _folder(self, name: str) -> str:
        if self.root is None:
            raise ValueError("a catalog without a root can't change tables")
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes the next version and then points to it."""
        path = self._folder(name)
        if name in self.shards:
            write_sharded(df, self.shards[name], path)
            self._point(name, Folders({path: written(self.spark, path)}), df)
        else:
            df.write.parquet(path)
            self.tables[name] = self.spark.read.parquet(path)
        self.appended[name] = 0

    def _point(self, name: str, folders: Folders, like: DataFrame) -> None:
        """The rows of a sharded table are those of these folders from now on."""
        self.folders[name] = folders
        df = folders.read(self.spark)
        self.tables[name] = with_shard(like.drop(*LAYOUT).limit(0), self.shards[name]) if df is None else df

    def insert(self, name: str, rows: DataFrame) -> int:
        """The number of new rows. They are written to a folder of their own, beside what the table has; every MOST_FOLDERS times all is written together."""
        path = self._folder(name)
        shards, old = self.shards.get(name), self.tables[name]
        if shards and shards.key not in rows.columns:
            rows = rows.withColumn(shards.key, F.lit(None).cast("string"))
        if shards:
            write_sharded(rows, shards, path)
        else:
            rows.write.parquet(path)
        new = self.spark.read.parquet(path)
        n = new.count()  # of the written files' footers; rows is evaluated once
        if not n:
            return 0
        if shards and name in self.folders:
            self._point(name, self.folders[name].added(path, written(self.spark, path)), rows)
        else:
            self.tables[name] = dml.inserted(old, new)
        self.appended[name] = self.appended.get(name, 0) + 1
        if self.appended[name] >= MOST_FOLDERS:
            self.replace(name, self.table(name).drop(*LAYOUT))
        return n

    bulk_insert = insert

    def update(self, name: str, assignments: list[tuple[str, d.Expr]], where: list[d.Expr]) -> int:
        return self._change(name, where, lambda df: dml.updated(df, assignments, where))

    def delete(self, name: str, where: list[d.Expr]) -> int:
        return self._change(name, where, lambda df: dml.deleted(df, where))

    def _change(self, name: str, where: list[d.Expr], change) -> int:
        """Of a sharded table only the shards that the conditions can match are read and written."""
        n = dml.matching(self.visible(name, where), where)
        if not n:
            return 0
        shards, touched = self.shards.get(name), None
        if shards and name in self.folders:
            touched = shards.matching(where)
        if touched is None:
            self.replace(name, change(self.table(name).drop(*LAYOUT)))
        else:
            self.rewrite(name, touched, change)
        return n

    def rewrite(self, name: str, touched: set[int], change=lambda df: df) -> None:
        """Writes the rows of these shards, changed, to another folder; the others stay where they are."""
        path, like = self._folder(name), self.table(name)
        rows = like.filter(F.col(SHARD).isin(sorted(touched))).drop(*LAYOUT)
        write_sharded(change(rows), self.shards[name], path)
        self._point(name, self.folders[name].replaced(touched, path, written(self.spark, path)), like)

    # Change records

    def apply_tx(self, name: str, records: DataFrame, schema) -> None:
        """The table after change records (lsn, tbl, tid, op, row), of which those of the table count: its rows are those that the records leave."""
        self.create_table(name, journal.replay(records, name, schema).drop("tid"))

    def recover(self, path: str, schemas: dict[str, object]) -> None:
        """All tables of a journal, by their names and schemas."""
        log = journal.read_journal(self.spark, path)
        for name, schema in schemas.items():
            self.apply_tx(name, log, schema)

    # Indexes

    def create_index(self, name: str, index: str, keys: list[d.Order | d.Expr | str]) -> None:
        """Metadata only: an index names access paths and never changes what a query returns."""
        orders = [k if isinstance(k, d.Order) else d.Order(d.Column(k) if isinstance(k, str) else k) for k in keys]
        self.indexes.setdefault(name, {})[index] = orders

    def index(self, name: str, index: str) -> list[d.Order]:
        return self.indexes[name][index]

    def indexes_for(self, name: str) -> dict[str, list[d.Order]]:
        return self.indexes.get(name, {})

    def index_scan(self, name: str, index: str, sargs: dict[str, list] | None = None, descending: bool = False) -> DataFrame:
        """Rows by search arguments, in the order of the index."""
        df = self.table(name)
        keys = [lower(o.expr, df) for o in self.index(name, index)]
        condition = key_condition(keys, sargs or {})
        df = df if condition is None else df.filter(condition)
        down = [o.descending != descending for o in self.index(name, index)]
        return df.orderBy(*[k.desc_nulls_last() if x else k.asc_nulls_last() for k, x in zip(keys, down, strict=True)])

    def index_only_scan(self, name: str, index: str, sargs: dict[str, list] | None = None) -> DataFrame:
        """_key, _count and _tids of each index key."""
        df = self.with_tids(name)
        keys = [lower(o.expr, df) for o in self.index(name, index)]
        condition = key_condition(keys, sargs or {})
        df = df if condition is None else df.filter(condition)
        return df.groupBy(F.array(*[k.cast("string") for k in keys]).alias("_key")).agg(F.count(F.lit(1)).alias("_count"), F.sort_array(F.collect_set("_tid")).alias("_tids"))

    # Shards

    def shard(self, name: str, key: str, count: int, sets: int = 1) -> Shards:
        """Lays a table out by shards, dealt to replica sets in equal runs."""
        self.shards[name] = Shards(key, count, {s: s * sets // count for s in range(count)})
        if self.tables[name] is not None and self.root is not None:
            self.replace(name, self.table(name))
        elif self.tables[name] is not None:
            self.tables[name] = with_shard(self.table(name), self.shards[name])
        return self.shards[name]

    def reshard(self, name: str, shard: int, target: int) -> int:
        """Moves a shard's rows to another replica set and returns their number. A failure leaves rows and map as they were."""
        shards, moved = self.shards[name], {}

        def work():
            moved["n"] = self.table(name).filter(F.col(SHARD) == shard).count()
            if name in self.folders:
                path, like = self._folder(name), self.table(name)
                rows = like.filter(F.col(SHARD) == shard).drop(*LAYOUT)
                write_sharded(rows, Shards(shards.key, shards.count, shards.assignment | {shard: target}), path)
                self._point(name, self.folders[name].replaced({shard}, path, written(self.spark, path)), like)

        shards.move(shard, target, work)
        if name not in self.folders:
            self.tables[name] = with_shard(self.table(name).drop(*LAYOUT), shards)
        return moved["n"]

    def placement(self, name: str) -> DataFrame:
        """The rows with the shard and the replica set that hold them."""
        return self.table(name)

    def visible(self, name: str, where: list[d.Expr]) -> DataFrame:
        """The table as a query with these conditions reads it: only the shards that can match."""
        df = self.table(name)
        return pruned(df, self.shards[name], where).drop(*LAYOUT) if name in self.shards else df

    def backends(self, name: str, where: list[d.Expr]) -> int:
        """How many replica sets a query with these conditions asks; 0 for a table without shards."""
        if name not in self.shards:
            return 0
        shards = self.shards[name]
        touched = shards.matching(where)
        return len(set(shards.assignment.values()) if touched is None else {shards.assignment[s] for s in touched})

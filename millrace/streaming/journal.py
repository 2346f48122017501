"""A table as the last change of each of its rows.

A record is (lsn, tbl, tid, op, row): op is insert, update or delete, row is the JSON text of the
row after the change. Of a row's records the one with the highest lsn counts, whatever order or
how often they come, so replay is idempotent and late records do no harm.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "lsn long, tbl string, tid long, op string, row string"
#: Parts of a live table; a batch rewrites those that it touches.
PARTS = 64


def last_changes(log: DataFrame) -> DataFrame:
    """One record for each row of each table. Partial aggregation leaves one of a key for each task, so a row that changes all the time is no hot key."""
    best = F.max_by(F.struct("op", "row", "lsn"), "lsn")
    return log.groupBy("tbl", "tid").agg(best.alias("x")).select("x.lsn", "tbl", "tid", "x.op", "x.row")


def replay(log: DataFrame, tbl: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a table after all changes, with their tid."""
    live = last_changes(log.filter(F.col("tbl") == tbl)).filter("op != 'delete'")
    return live.select("tid", F.from_json("row", schema).alias("r")).select("tid", "r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of RECORD objects, one a line."""
    return spark.read.schema(RECORD).json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal of lines {op, payload}, payload being [table, tid, row] or, for an update, [table,
    tid, old, new].

    The lsn is a line's place: its file's path, by code point, then where in the file it stands.
    So the files of a journal are in order if their names are. A reader gives the lines of one
    stretch of a file in order; which stretches share a task doesn't matter."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    part = F.from_json("value", "op string, payload array<string>")
    x = spark.read.text(path).select(place.alias("lsn"), part.alias("x")).select("lsn", F.col("x.op").alias("op"), F.col("x.payload").alias("p"))
    return x.select("lsn", F.get("p", F.lit(0)).alias("tbl"), F.get("p", F.lit(1)).cast("long").alias("tid"), "op", F.get("p", F.size("p") - 1).alias("row"))


def append_log(records: DataFrame, path: str) -> None:
    records.select("lsn", "tbl", "tid", "op", "row").write.mode("append").json(path)


class LiveTable:
    """The last changes in a folder, in parts by row, and a stream that advances them.

    A batch writes the parts that it touches to a folder of its own, and then, by one rename, a
    map ``m{batch}`` that says for each part which batch's folder holds it. The highest map
    counts, so a batch that breaks off before the rename has changed nothing, and one that is run
    again afterwards finds itself done. Folders that neither this map nor the one before names go."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _maps(self) -> list[int]:
        path, fs = self._path()
        return sorted(int(m[1]) for x in (fs.listStatus(path) if fs.exists(path) else []) if (m := re.fullmatch(r"m(\d+)", x.getPath().getName())))

    def _parts(self, version: int | None) -> dict[int, int]:
        """The batch that holds each part."""
        return {} if version is None else {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.folder}/m{version}", wholetext=True).first()[0]).items()}

    def _point(self, version: int, parts: dict[int, int]) -> None:
        """Makes a map current: written aside, then renamed."""
        path, fs = self._path(f".m{version}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not fs.rename(path, self._path(f"m{version}")[0]):
            raise OSError(f"can't rename to m{version} in {self.folder}")

    def version(self) -> int | None:
        return max(self._maps(), default=None)

    def _read(self, parts: dict[int, int]) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*[f"{self.folder}/v{v}/_part={k}" for k, v in sorted(parts.items())]) if parts else self.spark.createDataFrame([], RECORD)

    def changes(self) -> DataFrame:
        return self._read(self._parts(self.version()))

    def table(self, tbl: str, schema: str | T.StructType) -> DataFrame:
        return replay(self.changes(), tbl, schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        old = self.version()
        if old is not None and old >= number:
            return
        known, part = self._parts(old), F.pmod(F.xxhash64("tbl", "tid"), F.lit(PARTS)).cast("int")
        new = last_changes(batch.select("lsn", "tbl", "tid", "op", "row")).persist()
        try:
            touched = {r[0] for r in new.select(part).distinct().collect()}  # PARTS numbers at most
            before = self._read({k: v for k, v in known.items() if k in touched})
            merged = last_changes(before.unionByName(new)).withColumn("_part", part)
            merged.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/v{number}")
        finally:
            new.unpersist()
        now = known | dict.fromkeys(touched, number)
        self._point(number, now)
        self._clean(old, number, known, now)

    def _clean(self, old: int | None, number: int, known: dict[int, int], now: dict[int, int]) -> None:
        """A reader of the map before this one still finds its folders."""
        path, fs = self._path()
        used = {*known.values(), *now.values()}
        for x in fs.listStatus(path):
            kind, n = x.getPath().getName()[0], x.getPath().getName()[1:]
            if n.isdigit() and (kind == "v" and int(n) not in used or kind == "m" and int(n) not in (old, number)):
                fs.delete(x.getPath(), True)

    def follow(self, log_folder: str, checkpoint: str):
        """Starts the stream over a log folder; the checkpoint remembers how far it has read."""
        log = self.spark.readStream.schema(RECORD).json(log_folder)
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)


def record(lsn: int, tbl: str, tid: int, op: str, row: dict | None) -> tuple:
    return lsn, tbl, tid, op, json.dumps(row)

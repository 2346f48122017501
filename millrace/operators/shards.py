"""Hash shards as a data layout: partition columns that a table's key decides.

The shard of a row is crc32 of its key's text, modulo the number of shards, and a small map says
which replica set holds a shard. A set has folders of its own, with one for each shard. Queries
with = or IN on the key read only their shards' folders; a change rewrites only the folders of
the shards that it can touch; moving a shard writes its rows under the other set, with the map
changed in the same step, under a lock.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dialect as d
from ..errors import ShardKeyUpdateError, ShardLockedError, UnsupportedQueryError
from ..functions import hashmod, shard_of
from . import append

SHARD, SET = "_shard", "_set"
#: Columns that the layout adds.
LAYOUT = (SHARD, SET)


@dataclass
class Shards:
    key: str
    count: int
    assignment: dict[int, int]
    locked: set[int] = field(default_factory=set)

    def sets(self) -> dict[int, list[int]]:
        """The shards of each replica set."""
        out: dict[int, list[int]] = {}
        for shard, target in sorted(self.assignment.items()):
            out.setdefault(target, []).append(shard)
        return out

    def matching(self, where: list[d.Expr]) -> set[int] | None:
        """Shards that rows with these conditions can be in; None: any."""
        found = None
        for c in where:
            if isinstance(c, d.Compare) and c.op == "=" and c.left == d.Column(self.key) and isinstance(c.right, d.Literal):
                own = {shard_of(c.right.value, self.count)}
            elif isinstance(c, d.In) and c.expr == d.Column(self.key) and all(isinstance(v, d.Literal) for v in c.values):
                own = {shard_of(v.value, self.count) for v in c.values}
            else:
                continue
            found = own if found is None else found & own
        return found

    def check(self, touched: set[int] | None) -> None:
        if self.locked and (touched is None or touched & self.locked):
            raise ShardLockedError(f"shards {sorted(self.locked)} are being moved")

    def check_update(self, names: list[str]) -> None:
        if self.key in names:
            raise ShardKeyUpdateError(f"{self.key} decides the shard of a row")

    def move(self, shard: int, target: int, work=None) -> None:
        """Assigns a shard to another replica set; work() runs under the lock, and a failure leaves everything as it was."""
        if shard not in self.assignment or target not in set(self.assignment.values()):
            raise UnsupportedQueryError(f"no shard {shard} or replica set {target}")
        self.check({shard})
        self.locked.add(shard)
        try:
            if work:
                work()
            self.assignment[shard] = target
        finally:
            self.locked.discard(shard)


def with_shard(df: DataFrame, shards: Shards) -> DataFrame:
    """df with the layout's columns."""
    shard = hashmod(F.col(shards.key), F.lit(shards.count)).cast("int")
    sets = F.create_map(*[F.lit(x) for pair in sorted(shards.assignment.items()) for x in pair])
    return df.withColumn(SHARD, shard).withColumn(SET, F.element_at(sets, F.col(SHARD)))


def write_sharded(df: DataFrame, shards: Shards, path: str, salts: int = 8) -> None:
    """A folder for each set, with one for each shard. Tasks take a shard's rows by a salt of the row, so that a hot key's shard isn't one task's."""
    out = with_shard(df.drop(*LAYOUT), shards)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in LAYOUT]), F.lit(salts))
    out.repartition(F.col(SHARD), salt).write.mode("overwrite").partitionBy(SET, SHARD).parquet(path)


@dataclass
class Folders:
    """Where the rows of a sharded table are: written folders, each with the sets of the shards that still count in it."""

    roots: dict[str, dict[int, int]] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows with the layout's columns, which are folders, so that filters on them prune."""
        parts = [spark.read.option("basePath", root).parquet(*[f"{root}/{SET}={s}/{SHARD}={k}" for k, s in sorted(held.items())]) for root, held in self.roots.items() if held]
        return append(*parts) if parts else None

    def replaced(self, shards: set[int], root: str, held: dict[int, int]) -> Folders:
        """With the rows of these shards in another folder."""
        kept = {r: {k: s for k, s in old.items() if k not in shards} for r, old in self.roots.items()}
        return Folders({r: h for r, h in kept.items() if h} | ({root: held} if held else {}))

    def added(self, root: str, held: dict[int, int]) -> Folders:
        return Folders(self.roots | ({root: held} if held else {}))


def written(spark: SparkSession, root: str) -> dict[int, int]:
    """The shards that a written folder has, with their sets."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{SET}=*/{SHARD}=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return {int(x.getPath().getName().partition("=")[2]): int(x.getPath().getParent().getName().partition("=")[2]) for x in found}


def pruned(df: DataFrame, shards: Shards, where: list[d.Expr]) -> DataFrame:
    """The rows of matching shards: a filter on the partition column, which the scan's PartitionFilters take."""
    touched = shards.matching(where)
    shards.check(touched)
    if touched is not None and SHARD in df.columns:
        df = df.filter(F.col(SHARD).isin(sorted(touched)))
    return df

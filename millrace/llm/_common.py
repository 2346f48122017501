"""What the operators share: table access, white space, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the data contracts, U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch; hashes of text that may be shared by different texts (of 5e10 texts about 70 are).
BATCH, CLASHES = 2 << 20, 10_000
#: Spark's setting that the shuffle files of a statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't white space."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests), a temporary one."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if said:
        return said
    if (own := sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own := "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return own


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session already asks for less: a row is a whole text, and ten thousand of them are no batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH + 1))) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


class Workspace:
    """Tables that cut lineage: written once to the shared folder and read from there.

    A written table outlives the executors that wrote it, and what follows sees one
    fixed set of rows even if tasks are run again. Spark deletes the shuffle files of a plan when
    the driver collects the plan as garbage; left to chance, the files of all steps lie side by
    side. So the write that makes a table has Spark delete its shuffle files when it ends (Spark
    4.1 and later; before, a collection by the driver frees those of the step before)."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path, fs = self._files(f"{self.root}/{name}")
            fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, the ones that a result still reads."""
        path, fs = self._files(self.root)
        self.drop(*[n for x in fs.listStatus(path) if (n := x.getPath().getName()) not in names])


def text_classes(base: DataFrame, text_col: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """base with _class, a number for each distinct text, and a table with a row for each class:
    _class, _copies, _bytes, and _least, the least _id of its rows.

    The number is a 64-bit hash of the text. Where a second hash shows that different texts share
    it, both make the number. Partial aggregation leaves one row of a text for each task."""
    hashes = F.xxhash64(text_col), F.xxhash64(F.lit("second"), text_col)
    known = space.save(
        base.groupBy(hashes[0].alias("_h"), hashes[1].alias("_v")).agg(F.count(F.lit(1)).alias("_copies"), F.max(F.octet_length(text_col)).alias("_bytes"), F.min("_id").alias("_least")), "texts"
    )
    clash = known.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h").limit(CLASHES + 1).collect()
    if len(clash) > CLASHES:
        raise ValueError(f"more than {CLASHES} hashes are shared by different texts")

    def number(h, v):
        return F.when(h.isin([r["_h"] for r in clash]), F.xxhash64(h, v)).otherwise(h) if clash else h

    return base.withColumn("_class", number(*hashes)), known.select(number(F.col("_h"), F.col("_v")).alias("_class"), "_copies", "_bytes", "_least")


def give_back() -> None:
    """Returns free memory to the system. A worker process lives on after a task, idle or with tasks of other operators."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def per_text(df: DataFrame, id_col: str, text_col: str, make, columns: str, step: int = 256, done=lambda: None) -> DataFrame:
    """The id of each row, and what make()(texts) says of its text (null: empty) as Arrow arrays.

    Rows stream through in slices of ``step`` texts, so memory follows the largest slice and not
    the partition; make() is called once for each task, done() at its end, to empty caches that
    would stay with the worker process."""

    def run(batches):
        import pyarrow as pa

        f = make()
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    texts = [x or "" for x in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), *f(texts)], names=names)
        finally:
            done()
            give_back()

    small_batches(df.sparkSession)
    names = ["_id", *[c.strip().split(" ")[0] for c in columns.split(";")]]
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, {columns.replace(';', ',')}").withColumnRenamed("_id", id_col)

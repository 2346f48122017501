"""From raw documents to encoded training text, in five written stages.

Each stage works on all rows that the one before kept, and its decisions take effect: toxic
documents go, one of each group of exact copies stays, one of each group of near copies stays,
the rest is repeated or left out to meet the sources' targets, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from millrace.llm._common import Workspace, table


#: The column that names a row within a stage; no column of documents may have its name.
KEY = "__millrace_row"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs, written with a key for each row: (doc_id is null, doc_id, number). Ties go by doc_id, null last, and repeated rows stay apart."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("at"))
    return Workspace(docs.sparkSession, name).save(docs.withColumn(KEY, key), "rows")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of keyed rows those whose keys are given, without their keys."""
    return rows.withColumn("__at", F.col(f"{KEY}.at")).join(keys.select(F.col(f"{KEY}.at").alias("__kept")), F.col("__at") == F.col("__kept"), "left_semi").drop(KEY, "__at")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic, in one scan: nothing is joined back.

    Decided by text, so repeated rows go or stay together. Null and empty texts get the score of
    examples without evidence, and stay unless most of those are toxic; without labels all stay.
    No rows give no rows; other columns stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row: the longest original, then the least id.

    Decided by row: of repeated rows one stays, whatever its id, and null texts count as empty,
    of which one stays too. No rows give no rows; other columns stay as they are."""
    rows = keyed(docs, "copies")
    return _only(rows, exact_dedup.exact_dedup(rows, id_col=KEY).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the row of the least id (null ids last).

    Decided by row, so one of repeated rows stays. Texts without words, null ones too, are similar
    to nothing, and all stay. No rows give no rows; other columns stay as they are."""
    rows = keyed(docs, "near")
    return _only(rows, ngram_join.similar_groups(rows, id_col=KEY).filter(F.col(KEY) == F.col("component_id")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.

    Rows without words have no size and stay out if the mix doesn't need their number. The copies
    of repeated rows are dealt evenly among them. No rows give no rows; other columns stay as they are."""
    rows = keyed(docs, "mixed")
    slim = rows.select(F.col(f"{KEY}.at").alias("__at"), F.col("doc_id").alias("__of"), F.col("source").alias("__source"), mixing.row_hash("doc_id", "text").alias("__hash"))
    taken = mixing.mix_distinct(docs).select(F.col("_id").alias("__to"), F.col("_source").alias("__from"), F.col("_hash").alias("__found"), F.col("_rows").alias("__rows"), F.col("_copies").alias("__copies"))
    met = slim.join(taken, F.col("__of").eqNullSafe(F.col("__to")) & F.col("__source").eqNullSafe(F.col("__from")) & (F.col("__hash") == F.col("__found")))
    nth = F.row_number().over(W.partitionBy("__of", "__source", "__hash").orderBy("__at"))
    each = mixing.dealt(F.col("__copies"), F.col("__rows"), nth - 1)
    times = Workspace(spark, "times").save(met.select("__at", each.alias("__times")).filter("__times > 0"), "times").withColumnRenamed("__at", "__row")
    out = rows.withColumn("__at", F.col(f"{KEY}.at")).join(times, F.col("__at") == F.col("__row"))
    return out.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids; repeated rows each get their row, and no rows give no rows."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: SQL can't express the stages; the tests hold each against a plainer version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), str(k))
        if k > 1:
            space.drop(str(k - 2))
    return docs

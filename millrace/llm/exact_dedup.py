"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut where its own characters say so, each distinct chunk
gets one verified identifier, and two texts are equal when their ordered lists of identifiers
are. Whole texts stay in the scan: what is shuffled are a few dozen bytes for each chunk of
about a thousand characters. Only DataFrame operations are used.

Hot groups: chunks and recipes are counted with partial aggregation before any shuffle, so a
chunk or text that a third of all rows hold arrives as one row from each task; the two joins
back are plain equi-joins, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, squeezed, table, whole

#: Letters and digits from the beginning, and from the end, of each script: Latin, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, kana, Han, Hangul.
EARLY = r"0-4A-Fa-f\u00e0-\u00ea\u03b1-\u03b8\u0430-\u0437\u05d0-\u05d6\u0621-\u062e\u0905-\u0920\u0e01-\u0e14\u3041-\u305f\u30a1-\u30bf\u4e00-\u67ff\uac00-\ub9ff"
LATE = r"5-9M-Zm-z\u00eb-\u00ff\u03bd-\u03c9\u043c-\u044f\u05dc-\u05ea\u0633-\u064a\u0928-\u094d\u0e19-\u0e4e\u306a-\u3093\u30ca-\u30f3\u7000-\u9fff\ubd00-\ud7a3"
#: A chunk ends after this pattern, once it is LEAST characters long, or when it is MOST long.
BOUNDARY, LEAST, MOST = f"[{EARLY}][{LATE}][{EARLY}][{LATE}]", 1024, 8192


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _chars, _sha, and _parts: for each chunk in order its 64-bit key and its SHA-256."""
    pattern = f"(?s).{{{LEAST},{MOST}}}?{BOUNDARY}|.{{1,{MOST}}}"
    plain = docs.select(F.col(id_col).alias("_id"), F.length(whole(text_col)).alias("_chars"), squeezed(whole(text_col)).alias("_plain"))
    return plain.select(
        "_id", "_chars", F.sha2("_plain", 256).alias("_sha"),
        F.transform(F.regexp_extract_all("_plain", F.lit(pattern), F.lit(0)), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("v"))).alias("_parts"),
    )


def identifiers(parts: DataFrame) -> DataFrame:
    """h, v, ident: one row for each distinct chunk. The key h is the identifier where the
    SHA-256 shows that all its chunks are one; others get a key made of that digest."""
    distinct = parts.groupBy("h", "v").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    clash = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("h").alias("_clash"))
    return distinct.join(clash, F.col("h") == F.col("_clash"), "left").select("h", "v", F.when(F.col("_clash").isNull(), F.col("h")).otherwise(F.xxhash64("h", "v", F.lit("clash"))).alias("ident"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are the same characters after white space is deleted; of equal
    texts the one with the most code points in the original stays, then the smallest id (null
    ids last). Of repeated rows exactly one is kept. Null texts count as empty, empty texts
    equal each other, and an empty table gives no rows. Other columns of docs are ignored."""
    space = Workspace(docs.sparkSession, "exact")
    base = space.save(chunked(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "chunked")
    parts = base.select("_row", F.posexplode("_parts").alias("_at", "_part")).select("_row", "_at", "_part.h", "_part.v")
    ids = space.save(identifiers(parts), "identifiers")
    lists = parts.join(ids, ["h", "v"]).groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "ident"))), lambda x: x["ident"]).alias("_recipe"))
    rows = space.save(
        base.drop("_parts").join(lists, "_row", "left").withColumn("_recipe", F.coalesce("_recipe", F.array().cast("array<bigint>"))).withColumn("_key", F.xxhash64("_recipe")),
        "recipes",
    )
    space.drop("chunked", "identifiers")
    best = F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    groups = rows.groupBy("_key", "_recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("_best"))
    groups = groups.select(F.col("_key").alias("_k"), F.col("_recipe").alias("_r"), "group_size", F.col("_best._id").alias("keep_id"), F.col("_best._row").alias("_keep"))
    # Written, so that nothing but the join stands above the exchange of a hot recipe, and adaptive execution can split it.
    groups = space.save(groups, "groups")
    return rows.join(groups, (F.col("_key") == F.col("_k")) & (F.col("_recipe") == F.col("_r"))).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_row") == F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"), F.size("_recipe").alias("n_chunks")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
r AS (SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
             first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
"""

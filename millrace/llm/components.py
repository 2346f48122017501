"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """v, root for every node of edges (a, b): root is the smallest node that v reaches.

    A step takes each node's least neighbour with partial aggregation and joins it back; the hub
    of a large star is a hot key of a plain equi-join, which adaptive execution splits. Each
    step is a written table, so lineage stays short, and nothing reaches the driver but sums."""

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v != m").distinct()

    now, seen, k = space.save(linked(edges), f"{name}0"), None, 0
    if now.isEmpty():
        return now.select("v", F.col("m").alias("root"))
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("n")).union(now.select(F.col("m").alias("u"), F.col("v").alias("n")))
        least = both.groupBy("u").agg(F.min("n").alias("x")).select(F.col("u").alias("_u"), F.least("u", "x").alias("_m"))
        large = linked(both.join(least, F.col("u") == F.col("_u")).filter("n > u").select(F.col("n").alias("a"), F.col("_m").alias("b")))
        least = large.groupBy("v").agg(F.min("m").alias("_m")).select(F.col("v").alias("_u"), "_m")
        met = large.join(least, F.col("v") == F.col("_u"))
        small = linked(met.select(F.col("m").alias("a"), F.col("_m").alias("b")).union(met.select(F.col("v").alias("a"), F.col("_m").alias("b"))))
        k += 1
        old, now = now, space.save(small, f"{name}{k}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select("v", F.col("m").alias("root"))
        seen = mark
        space.drop(f"{name}{k - 1}")


def further(roots: DataFrame | None, edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """v, root after more edges. Only the roots that the new edges join meet again, so a later call costs as its new links and not as all."""
    if roots is None:
        return components(edges, space, name)
    end = lambda x: roots.select(F.col("v").alias(f"_v{x}"), F.col("root").alias(f"_r{x}"))
    met = edges.join(end("a"), F.col("a") == F.col("_va"), "left").join(end("b"), F.col("b") == F.col("_vb"), "left")
    new = components(met.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")), space, name)
    to = new.select(F.col("v").alias("_w"), F.col("root").alias("_to"))
    moved = roots.join(to, F.col("root") == F.col("_w"), "left").select("v", F.coalesce("_to", "root").alias("root"))
    return space.save(moved.union(new), f"{name}all")

"""Mixing sources to target weights by the cube method.

Every row is taken floor(r) times, r being target over size of its source, and once more with
probability r - floor(r). Which rows get the extra copy is a balanced sample: the flight phase
moves three rows at a time along the null space of the two constraints (documents and words of
the source) until one of them is decided, so both totals stay exactly as expected. At most two
rows of a source stay undecided in a group; they meet again in ever fewer groups, and the
last two of a source are landed, together with a few of its rows of all sizes, on the choice whose words
come nearest.

Repeated rows are counted first and flown as one, with the sum of their expectations; what they
get is dealt out evenly. Rows go to groups by a hash of their id and text, and every draw is
seeded by the group, so the result doesn't depend on how the input is partitioned. A source that
holds a third of all rows is spread over all groups like any other, and so is a row that is
repeated as often. What is shuffled are an id and a few numbers for each row; the undecided rows
are at most two for each source and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, table, whole, words

#: Rows of a group of the first flight on average, and how many groups of one flight meet in one of the next.
GROUP, MEET = 40_000, 2_000
#: Rows of each source, spread over the sizes, that the last flight leaves to the landing besides its own two.
LANDING = 12


def source_targets(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """_of, _source_size, _target: for each source its words and its share of all words.

    Weights go to the sources by code point (null last), repeating. A target stops at ``most``
    times the source's size; the excess goes to the others by weight. With the sources in order
    of cap / weight the capped ones come first, so running sums give the level of the rest. The
    windows run over one row for each source."""
    per = rows.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("_source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", most * F.col("_source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("_source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / weight)
    # A source is capped while the level of those from it on is above its own cap over weight.
    free = F.col("_level") * F.col("_w") <= F.col("_cap")
    level = F.min(F.when(free, F.struct(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.col("_source"), F.col("_level")))).over(all_)["_level"]
    return per.select(F.col("_source").alias("_of"), "_source_size", F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap").cast("double"))).alias("_target"))


def flight(p: list[float], size: list[int], draw) -> None:
    """Moves the probabilities p, in place, until at most two are strictly between 0 and 1.

    The sums of p and of p * size stay as they are, and so does the expectation of each."""
    held: list[int] = []
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        held.append(k)
        if len(held) < 3:
            continue
        i, j, m = held
        u = size[j] - size[m], size[m] - size[i], size[i] - size[j]
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for x, step in zip(held, u, strict=True):
            if step > 0:
                up, down = min(up, (1 - p[x]) / step), min(down, p[x] / step)
            elif step < 0:
                up, down = min(up, p[x] / -step), min(down, (1 - p[x]) / -step)
        move = up if draw() * (up + down) < down else -down
        for x, step in zip(held, u, strict=True):
            q = p[x] + move * step
            p[x] = 0.0 if q < 1e-12 else 1.0 if q > 1 - 1e-12 else q
        held = [x for x in held if 0.0 < p[x] < 1.0]


def land(p: list[float], size: list[int]) -> None:
    """Decides the few left: the choice whose words come nearest, with a small price for documents off."""
    import numpy as np

    open_ = [k for k in range(len(p)) if 0.0 < p[k] < 1.0]
    if not open_:
        return
    choice = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    q, s = np.array([p[k] for k in open_]), np.array([size[k] for k in open_], float)
    off = np.abs(choice @ s - q @ s) + 0.02 * s.mean() * np.abs(choice.sum(axis=1) - q.sum())
    for x, k in zip(choice[int(np.argmin(off))], open_, strict=True):
        p[k] = float(x)


def _fly(rows: DataFrame, group: str, seed: int, last: bool) -> DataFrame:
    schema = rows.schema

    def one(pdf):
        import random

        pdf = pdf.sort_values(["_size", "_hash"], ascending=[False, True], kind="stable")
        out = pdf["_p"].to_numpy().copy()
        for name, at in sorted(pdf.reset_index(drop=True).groupby("_source", dropna=False, sort=False).indices.items() if not pdf["_source"].isna().all() else [("", range(len(pdf)))], key=lambda kv: str(kv[0])):
            at = list(at)
            p, size = [float(out[k]) for k in at], [int(x) for x in pdf["_size"].to_numpy()[at]]
            # Rows of all sizes stay on the ground in the last flight, for the landing to choose from.
            ground = {(2 * k + 1) * len(p) // (2 * LANDING) for k in range(LANDING)} if last else set()
            fly = [k for k in range(len(p)) if k not in ground]
            q = [p[k] for k in fly]
            flight(q, [size[k] for k in fly], random.Random(f"{seed} {int(pdf['_group'].iloc[0])} {name}").random)
            for k, x in zip(fly, q, strict=True):
                p[k] = x
            if last:
                land(p, size)
            out[at] = p
        pdf["_p"] = out
        return pdf

    return rows.groupBy(group).applyInPandas(one, schema)


def row_hash(id_col: str, text_col: str):
    """What repeated rows have in common."""
    return F.xxhash64(F.col(id_col), whole(text_col))


def dealt(copies, rows, nth):
    """Of the copies of ``rows`` repeated rows what the nth (from 0) gets."""
    return F.floor(copies / rows).cast("long") + F.when(nth < copies % rows, 1).otherwise(0)


def mix_distinct(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for rows of docs that have id, source and text in common: _id, _source, _hash, _size, _rows
    (how many they are), _source_size, _target, _copies (of all together, at most ``most`` for each)."""
    space = Workspace(docs.sparkSession, "mix")
    text = whole(text_col)
    each = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.size(words(text)).cast("long").alias("_size"), row_hash(id_col, text_col).alias("_hash"))
    rows = space.save(each.groupBy("_id", "_source", "_size", "_hash").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    n = rows.count()
    groups = max(1, -(-n // GROUP))
    targets = source_targets(rows, weights, most)
    ratio = F.when(F.col("_source_size") > 0, F.least(F.lit(float(most)), F.col("_target") / F.col("_source_size"))).otherwise(0.0) * F.col("_rows")
    rows = rows.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumn("_base", F.floor(ratio).cast("long")).withColumn("_p", ratio - F.floor(ratio)).withColumn("_group", F.pmod("_hash", F.lit(groups)))
    done, level = None, 0
    while True:
        rows = space.save(_fly(rows, "_group" if level == 0 else "_meet", seed + level, groups == 1), f"flight{level}")
        if groups == 1:
            break
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done = rows.filter(~open_) if done is None else done.unionByName(rows.filter(~open_), allowMissingColumns=True)
        groups = -(-groups // MEET)
        rows = rows.filter(open_).withColumn("_group", F.floor(F.col("_group") / MEET)).withColumn("_meet", F.struct("_group", "_source"))
        level += 1
    rows = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
    space.drop("sizes")
    return rows.select("_id", "_source", "_hash", "_size", "_rows", "_source_size", "_target", (F.col("_base") + F.round("_p").cast("long")).alias("_copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, size (its words), source_size, target (of its source), copies, taken.

    Sizes of null and empty texts are 0. A null source is a source of its own, the last in order.
    Where nothing has a size every target is 0 and nothing is taken. The copies of repeated rows
    are dealt evenly among them. Other columns of docs are ignored."""
    rows = mix_distinct(docs, weights, most, seed, id_col, text_col, source_col)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("_nth"))
    copies = dealt(F.col("_copies"), F.col("_rows"), F.col("_nth"))
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

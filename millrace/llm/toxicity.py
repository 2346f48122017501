"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes a bounded, documented sample of labelled texts, chooses the terms that tell the
labels apart, and puts the examples' TF-IDF vectors into an inverted index whose postings are
cut into blocks of examples, with the largest weight of each term in each block. A search adds
up those maxima to a bound for every block, opens blocks from the highest bound down, and stops
when no closed block can hold one of the k nearest: the result is that of an exhaustive search.
The neighbours vote with their cosines, each label weighing what the sample took of it; examples
as near as the last of them all vote, with the places that are left shared evenly, so neither
label nor id decides a tie. A logistic curve fitted on leave-one-out votes turns the vote into a probability.

Scoring is one scan without a shuffle. What each task gets is the index, whose size is bounded
by the parameters POSITIVE and NEGATIVE and not by the data.

The terms are all words that tell the labels apart by more than chance, however many; equal and
nearly equal examples of a label count once in that. Words without evidence are left out on
purpose: with all words of the sample in the index the neighbours follow language and topic.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, per_text, table, whole

#: The bound of the fitted sample: examples of each label, the first by hash of their id.
POSITIVE, NEGATIVE = 2000, 4000
#: Examples of a block, and voting neighbours.
BLOCK, NEAREST = 32, 15
#: Examples of one label whose sets of words have this Jaccard similarity, in hundredths, count once as evidence.
ALIKE = 75
#: So many of the best terms count even without evidence beyond chance.
LEAST = 8
#: Cosines this close are equal; texts whose scores a task remembers.
TIE, CACHED = 1e-9, 8192
#: The least slope of the calibration.
LEAST_SLOPE = 0.05
#: A text with at least this score is predicted toxic.
LIMIT = 0.3
#: Words for search: runs of letters, in lower case. The second is the first in Java's terms.
_TERM, TERM_SQL = re.compile(r"[^\W\d_]+"), r"\p{L}+"


class BlockMaxIndex:
    """Exact top-k by inner product of sparse vectors with non-negative weights."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = BLOCK):
        import numpy as np

        self.n, self.block = len(vectors), block
        n_blocks = -(-self.n // block)
        rows = sorted((t, d, w) for d, v in enumerate(vectors) for t, w in v.items())
        self.docs = np.array([d for _, d, _ in rows], np.int64)
        self.weights = np.array([w for _, _, w in rows], np.float64)
        at = np.array([t * n_blocks + d // block for t, d, _ in rows], np.int64)
        #: Where the postings of each term and block begin.
        self.start = np.searchsorted(at, np.arange(n_terms * n_blocks + 1)).astype(np.int64)
        self.n_blocks, self.max = n_blocks, np.zeros((n_terms, n_blocks))
        np.maximum.at(self.max.reshape(-1), at, self.weights)
        self.opened = 0

    def _scored(self, query: dict[int, float], k: int, skip: int = -1):
        """Scores, complete for all that are at least as good as the k-th best, and that best's; skip doesn't count."""
        import numpy as np

        score, least = np.zeros(self.n), 0.0
        if not query or not self.n:
            return score, least
        terms, q = np.fromiter(query.keys(), np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        bound = q @ self.max[terms]
        order = np.argsort(-bound, kind="stable")
        at, step = 0, 4
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] + TIE >= least:
            blocks = order[at : at + step]
            self.opened += len(blocks)
            cell = (terms[:, None] * self.n_blocks + blocks[None, :]).ravel()
            lo, size = self.start[cell], self.start[cell + 1] - self.start[cell]
            total = int(size.sum())
            if total:
                flat = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(total)
                np.add.at(score, self.docs[flat], self.weights[flat] * np.repeat(np.repeat(q, len(blocks)), size))
            if skip >= 0:
                score[skip] = 0.0
            at, step = at + len(blocks), step * 2
            if np.count_nonzero(score) >= k:
                least = -np.partition(-score, k - 1)[k - 1]
        return score, least

    def search(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k best (score, position), only scores above 0; of equal scores the first positions."""
        import numpy as np

        score, _ = self._scored(query, k)
        best = np.lexsort((np.arange(self.n), -np.round(score, 12)))[:k]
        return [(float(score[i]), int(i)) for i in best if score[i] > 0]

    def nearest(self, query: dict[int, float], k: int, skip: int = -1):
        """positions, scores, shares: the k best and all that are equal to the last of them, who share the places that are left for them."""
        import numpy as np

        score, least = self._scored(query, k, skip)
        at = np.flatnonzero((score > 0) & (score >= least - TIE))
        at = at[np.lexsort((at, -np.round(score[at], 9)))]
        near, share = score[at], np.ones(len(at))
        if len(at) > k:
            tied = near <= least + TIE
            share[tied] = (k - np.count_nonzero(~tied)) / np.count_nonzero(tied)
        return at, near, share


class Model:
    """Fitted on counts: for each example its id, label and term counts; weight: of each label."""

    def __init__(self, terms: list[str], examples: list[tuple[object, int, dict[str, int]]], weight: tuple[float, float], k: int = NEAREST):
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        n = len(examples)
        df = Counter(t for _, _, c in examples for t in c)
        self.idf = [math.log((n + 1) / (df[t] + 1)) + 1 for t in terms]
        vectors = [self.vector(c) for _, _, c in examples]
        # Examples whose strongest term is the same share blocks.
        order = sorted(range(n), key=lambda i: (max(vectors[i], key=vectors[i].get, default=-1), str(examples[i][0])))
        self.k, self.weight, self.cache = k, weight, {}
        self.ids, self.labels = [examples[i][0] for i in order], [examples[i][1] for i in order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(terms))
        blank = [y for v, y in zip(vectors, self.labels, strict=True) if not v]
        share = sum(weight[y] * y for y in blank) / sum(weight[y] for y in blank) if blank else 0.0
        self.blank = min(max(share, 0.001), 0.999)
        self.slope, self.shift = self._calibrated(vectors)

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        v = {i: (1 + math.log(c)) * self.idf[i] for t, c in counts.items() if (i := self.vocabulary.get(t)) is not None}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {i: w / norm for i, w in sorted(v.items())}

    def vote(self, near) -> float:
        """Distance-weighted share of label 1 among neighbours, drawn to the share of texts without evidence."""
        import numpy as np

        at, scores, shares = near
        label, voice = np.array([self.labels[i] for i in at]), scores * shares
        one, zero = (float(voice[label == y].sum()) * self.weight[y] if len(at) else 0.0 for y in (1, 0))
        some = 0.1 * (self.weight[0] + self.weight[1]) / 2
        return (one + some * self.blank) / (one + zero + some)

    def _calibrated(self, vectors) -> tuple[float, float]:
        """A logistic curve on the votes, each example's own vote left out, by Newton's method."""
        rows = [(self._logit(self.vote(self.index.nearest(v, self.k, i))), self.labels[i], self.weight[self.labels[i]]) for i, v in enumerate(vectors)]
        a, b = 1.0, 0.0
        if len({y for _, y, _ in rows}) < 2:
            return a, b
        for _ in range(50):
            ga, gb, haa, hab, hbb = 1e-3 * (1 - a), 0.0, 1e-3, 0.0, 1e-3
            for x, y, w in rows:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
                ga, gb, r = ga + w * (y - p) * x, gb + w * (y - p), w * p * (1 - p)
                haa, hab, hbb = haa + r * x * x, hab + r * x, hbb + r
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            size = max(1.0, abs(da), abs(db))
            a, b = a + da / size, b + db / size
            if abs(da) + abs(db) < 1e-9:
                break
        if a < LEAST_SLOPE:  # a higher vote never means a lower score: the shift is fitted alone
            a, b = LEAST_SLOPE, 0.0
            for _ in range(50):
                at = [(1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b)))), y, w) for x, y, w in rows]
                gb, hbb = sum(w * (y - p) for p, y, w in at), 1e-9 + sum(w * p * (1 - p) for p, _, w in at)
                b += max(-1.0, min(1.0, gb / hbb))
                if abs(gb / hbb) < 1e-9:
                    break
        return a, b

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        """Probability of label 1, and the three nearest examples."""
        known = self.vocabulary
        counts = Counter([t for t in _TERM.findall(text.lower()) if t in known])
        key = tuple(sorted(counts.items()))
        if (got := self.cache.get(key)) is None:
            near = self.index.nearest(self.vector(counts), self.k)
            z = self.slope * self._logit(self.vote(near)) + self.shift
            got = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [(float(x), int(i)) for i, x in zip(near[0][:3], near[1][:3], strict=True)]
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[key] = got
        return got


def held_out(id_col: str = "doc_id"):
    """Rows whose label is never learned."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def distinct_examples(sets) -> list:
    """Of (id, label, array of distinct word hashes) the ids that no earlier one taken of the label is alike to.

    Only sets that share one of their least words can be (prefix filter, exact), and only taken
    ones are compared with, so a group of copies of any size costs little."""
    import numpy as np

    taken, index = [], {}
    for i, y, words in sets:
        words = np.sort(np.asarray(words, np.int64))
        n = len(words)
        prefix = [(y, w) for w in words[: n - -(-ALIKE * n // 100) + 1].tolist()] or [(y, None)]
        for k in dict.fromkeys(k for w in prefix for k in index.get(w, ())):
            other = taken[k][1]
            if 100 * min(n, len(other)) < ALIKE * max(n, len(other)):
                continue
            both = len(np.intersect1d(words, other, assume_unique=True))
            if 100 * both >= ALIKE * (n + len(other) - both):
                break
        else:
            for w in prefix:
                index.setdefault(w, []).append(len(taken))
            taken.append((i, words))
    return [i for i, _ in taken]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the rows of labels that aren't held out; of several labels of one id the highest counts."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda y, n: known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    sample = first(1, POSITIVE).unionByName(first(0, NEGATIVE)).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["_id"], r["_y"]) for r in sample], known.schema)
    # The broadcast holds at most POSITIVE + NEGATIVE ids.
    terms = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    terms = terms.select("_id", "_y", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(TERM_SQL), F.lit(0))).alias("_term")).groupBy("_id", "_y", "_term").agg(F.count(F.lit(1)).alias("_n"))
    terms = terms.persist()
    n = Counter(r["_y"] for r in sample)
    weight = tuple(total.get(y, 0) / n[y] if n[y] else 1.0 for y in (0, 1))
    # Copies count once; the driver holds the bounded sample's word hashes.
    sets = terms.groupBy("_id", "_y").agg(F.collect_list(F.xxhash64("_term")).alias("_w")).orderBy(F.xxhash64("_id"), "_id")
    worded: set = set()
    ids = set(distinct_examples((r["_id"], r["_y"], worded.add(r["_id"]) or r["_w"]) for r in sets.toLocalIterator()))
    lone = Counter(r["_y"] for r in sample if r["_id"] in ids)
    lone.update({r["_y"] for r in sample if r["_id"] not in worded})  # texts without words are equal
    single = spark.createDataFrame([(r["_id"],) for r in sample if r["_id"] in ids], known.select("_id").schema)
    a, b = F.sum("_y"), F.count(F.lit(1)) - F.sum("_y")
    # Log-likelihood ratio of a term's presence by label.
    per = terms.join(F.broadcast(single), "_id").groupBy("_term").agg(a.alias("a"), b.alias("b"))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    one, zero, both = F.lit(float(lone[1])), F.lit(float(lone[0])), F.lit(float((lone[0] + lone[1]) or 1))
    seen = F.col("a") + F.col("b")
    ratio = part(F.col("a"), seen * one / both) + part(F.col("b"), seen * zero / both) + part(one - F.col("a"), (both - seen) * one / both) + part(zero - F.col("b"), (both - seen) * zero / both)
    ranked = per.withColumn("_g", F.round(ratio, 9))
    # With so many terms (of 4 texts or more) to choose from, this much would be expected of about one by chance.
    chance = math.log(max(1, per.filter("a + b >= 4").count()))
    best = [r["_term"] for r in ranked.orderBy(F.desc("_g"), "_term").limit(LEAST).collect()]
    best += [r["_term"] for r in ranked.filter(F.col("_g") >= chance).orderBy(F.desc("_g"), "_term").collect() if r["_term"] not in best[:LEAST]]
    counts: dict[object, dict[str, int]] = {r["_id"]: {} for r in sample}
    for r in terms.filter(F.col("_term").isin(best)).select("_id", "_term", "_n").collect() if best else []:
        counts[r["_id"]][r["_term"]] = r["_n"]
    terms.unpersist()
    return Model(best, [(r["_id"], r["_y"], counts[r["_id"]]) for r in sample], weight)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score, predicted, evidence (the three nearest examples: id as text, label, cosine).

    Null and empty texts, and those without a term of the index, get the score of examples
    without one and no evidence. Without labels every score is near 0. Repeated rows each get
    their row; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        m = shared.value
        kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

        def run(texts):
            found = [m.score(t) for t in texts]
            near = [[{"id": str(m.ids[i]), "label": m.labels[i], "cosine": round(s, 9)} for s, i in x[:3]] for _, x in found]
            return [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= LIMIT) for s, _ in found], pa.int32()), pa.array(near, kind)]

        return run

    return per_text(docs, id_col, text_col, make, "score double; predicted int; evidence array<struct<id:string,label:int,cosine:double>>", done=lambda: shared.value.cache.clear())


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that aren't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        try:
            for batch in batches:
                clean = [m.score(t or "")[0] < LIMIT for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
        finally:
            m.cache.clear()
            give_back()

    return docs.mapInArrow(run, docs.schema)

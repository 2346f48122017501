"""Quality rules as learned decision lists.

Statistics of a text are built-in SQL expressions, evaluated in one scan. From labelled texts a
list of rules is learned by sequential covering: each rule is a conjunction of thresholds, grown
by information gain on two thirds of the examples and pruned on the rest, and what it covers is
set aside before the next. The list comes out as one ordered conditional expression, so that
applying it is part of the same scan: no shuffle, no Python on the executors.

Fitting collects the statistics, a few numbers each, of at most EXAMPLES labelled texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import squeezed, table, whole, words

#: The bound of the fitted sample: labelled texts, the first by hash of their id.
EXAMPLES = 6000
#: Conditions of a rule, rules of a list, examples a rule must cover, and its least precision on examples that didn't grow it.
DEPTH, RULES, COVER, PRECISION = 3, 8, 8, 0.8
#: What counts as a symbol.
SYMBOLS = "[#*$%&|<>]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules are about: name and SQL over the statistics (n_words is at least 1 where they apply).
FEATURES = {
    "words": "n_words", "word_length": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines", "repeat_share": "n_repeat_words / n_words",
    "digit_share": "n_digits / word_chars", "upper_share": "n_upper / word_chars", "words_per_line": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.at!r}D"

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.at if self.above else row[self.feature] <= self.at


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and the statistics of each whole text.

    Repeated words are found by sorting the text's own 3-word windows by hash and words: equal
    windows are then neighbours. Each select names what the next uses more than once."""
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).select(
        "_id", words(text).alias("_w"), F.length(squeezed(text)).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    scalars = ("_id", "word_chars", "n_symbols", "n_digits", "n_upper")
    lines = F.size("_lines")
    step = base.select(
        *scalars, F.size("_w").cast("long").alias("n_words"), lines.cast("long").alias("n_lines"), (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("slice(arrays_zip(_w, slice(_w, 2, size(_w)), slice(_w, 3, size(_w))), 1, greatest(size(_w) - 2, 0))").alias("_windows"),
    )
    kept = (*scalars, "n_words", "n_lines", "n_dup_lines")
    step = step.select(*kept, F.sort_array(F.transform("_windows", lambda x, i: F.struct(F.xxhash64(x["_w"], x["1"], x["2"]).alias("h"), x.alias("x"), i.alias("i")))).alias("_s"))
    twins = "filter(arrays_zip(_s, slice(_s, 2, size(_s))), p -> p._s.h = p.`1`.h AND p._s.x = p.`1`.x)"
    step = step.select(*kept, F.expr(f"array_sort(array_distinct(flatten(transform({twins}, p -> array(p._s.i, p.`1`.i)))))").alias("_at"))
    # A window covers its three words, or fewer where the next one begins sooner.
    covered = "aggregate(transform(arrays_zip(_at, slice(_at, 2, size(_at))), p -> least(3, coalesce(p.`1` - p._at, 3))), 0L, (a, b) -> a + b)"
    return step.select(*kept, F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(rows: list[dict[str, float]], bad: list[bool]) -> list[Rule]:
    """Sequential covering: rules for bad rows, most useful first. Rows alternate between growing and pruning."""
    left, rules = list(range(len(rows))), []
    while len(rules) < RULES:
        grow, prune = [i for i in left if i % 3], [i for i in left if i % 3 == 0]
        rule = _pruned(_grown(rows, bad, grow), rows, bad, prune)
        if not rule:
            break
        hit = lambda part, r=rule: [i for i in part if all(c.holds(rows[i]) for c in r)]
        checked, covered = hit(prune), hit(left)
        if len(covered) < COVER or not checked or (sum(bad[i] for i in checked) + 0.5) / (len(checked) + 1) < PRECISION:
            break
        rules.append(rule)
        gone = set(covered)
        left = [i for i in left if i not in gone]
    return rules


def _grown(rows, bad, part: list[int]) -> Rule:
    rule: Rule = ()
    while len(rule) < DEPTH:
        p, n = sum(bad[i] for i in part), len(part)
        if not p or p == n:
            break
        best, gain = None, 1e-9
        for name in FEATURES:
            order = sorted(part, key=lambda i: rows[i][name])
            values, ones = [rows[i][name] for i in order], [0]
            for i in order:
                ones.append(ones[-1] + bad[i])
            for k in range(1, n):
                if values[k] == values[k - 1]:
                    continue
                for above, got, size in ((True, p - ones[k], n - k), (False, ones[k], k)):
                    if got >= COVER / 2 and (g := got * (math.log2(got / size) - math.log2(p / n))) > gain:
                        at = (values[k] + values[k - 1]) / 2
                        best, gain = Condition(name, above, float(f"{at:.6g}")), g
        if best is None:
            break
        rule = (*rule, best)
        part = [i for i in part if best.holds(rows[i])]
    return rule


def _pruned(rule: Rule, rows, bad, part: list[int]) -> Rule:
    """The beginning of the rule with the best balance of right and wrong on rows that didn't grow it."""
    best, value = (), 0.0
    for k in range(1, len(rule) + 1):
        hit = [i for i in part if all(c.holds(rows[i]) for c in rule[:k])]
        p = sum(bad[i] for i in hit)
        if hit and (v := (2 * p - len(hit)) / (len(hit) + 1)) > value + 1e-9:
            best, value = rule[:k], v
    return best


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The list learned from labels (0: bad). Texts that the base rules reject teach nothing; of several labels of one id the highest counts."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_known")).agg((F.max(label_col) <= 0).alias("_bad"))
    chosen = known.orderBy(F.xxhash64("_known"), "_known").limit(EXAMPLES)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_known"))
    # No filter on statistics here: pushed below them it would evaluate each anew for every use.
    stats = statistics(sample, "_id", "_text")
    bad = {r["_known"]: r["_bad"] for r in chosen.collect()}
    rows = stats.select("_id", base_failed().alias("_failed"), *[F.round(F.expr(f"CAST(try_divide({sql.replace(' / ', ', ')}) AS DOUBLE)" if " / " in sql else f"CAST({sql} AS DOUBLE)"), 9).alias(name) for name, sql in FEATURES.items()]).orderBy(F.xxhash64("_id"), "_id", *FEATURES).collect()
    rows = [r for r in rows if not r["_failed"]]
    return learn([{f: r[f] or 0.0 for f in FEATURES} for r in rows], [bad[r["_id"]] for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, else null."""
    out = None
    for k, rule in enumerate(rules):
        test = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(None).cast("int") if out is None else out


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the statistics, base_failed, rule (the first that rejects it, or null), kept.

    Null and empty texts have no words and fail the base rules. Without labels the list is empty
    and everything that passes the base rules is kept. Repeated rows each get their row; other
    columns are ignored."""
    stats = statistics(docs, id_col, text_col)
    out = stats.select(F.col("_id").alias(id_col), *BASE, base_failed().alias("base_failed"), F.when(~base_failed(), verdict(rules)).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))

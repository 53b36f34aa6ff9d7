"""Quality rules: a decision list over text statistics, learned from labelled documents.

Statistics, learning and verdict are DataFrame expressions. Sequential covering grows one
conjunction of thresholds at a time that separates bad from good documents, prunes it on
rows set apart, removes what it covers and goes on; the list is emitted as one conditional
expression, so applying it is a projection without a shuffle.
"""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.samples import labelled_sample
from statloom.session import cut_lineage

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "digit_share", "line_words"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, overlaps counted once."""

    def covered(places: Column) -> Column:
        # a window reaches over three words unless the next one begins before
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def same(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            equal = [F.coalesce(F.get(ordered, k + d)["g"] == x["g"], F.lit(False)) for d in (-1, 1)]
            return equal[0] | equal[1]

        return let(F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"])), covered)

    def among(grams: Column) -> Column:
        repeated = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(repeated, let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), same)).otherwise(F.lit(0).cast("long"))

    grams = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(grams, among)


def statistics(text: Column) -> Column:
    """The counts of one text as a struct of longs; a NULL text has no word."""
    value = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("long")
        lines = F.filter(F.split(value, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            count("[A-Z]").alias("n_upper"),
            count("[!?]").alias("n_marks"),
            count("[0-9]").alias("n_digits"),
            let(lines, F.size).cast("long").alias("n_lines"),
        )

    return let(F.filter(F.split(value, BLANK + "+"), lambda w: w != ""), counts)


def base_failed(s: Column) -> Column:
    """Too few words, or too many of them repeated, by a struct of ``statistics``."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What the rules look at: sizes and shares, 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclasses.dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.threshold if self.at_least else values[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclasses.dataclass(frozen=True)
class Rule:
    """A document that meets all conditions is rejected; precision is that on the rows set apart."""

    conditions: tuple[Condition, ...]
    precision: float

    def column(self, values: dict[str, Column]) -> Column:
        return functools.reduce(lambda a, b: a & b, (c.column(values) for c in self.conditions))

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def learn_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_label: int = 8192, cuts: int = 32, max_conditions: int = 4, max_rules: int = 12, min_precision: float = 0.97, min_support: int = 2) -> list[Rule]:
    """Rules that find documents of label 0, in the order in which they were learned.

    They are fitted on at most ``per_label`` documents of each label that pass the base
    rules, a third of them set apart for pruning and acceptance. Each class counts with its
    weight among all labels. Every step is one grouped count over the sample, of which the
    driver sees a row per feature and cut. Learning ends at the first rule that covers fewer
    than ``min_support`` of the rows set apart, or whose precision there stays below
    ``min_precision``. Without labels of both kinds there is no rule.
    """
    chosen = labelled_sample(labels, label, key, per_label)
    weights = {r["y"]: r["n"] for r in labels.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    # written before anything refers to the struct, or a filter would count the words again
    measured = cut_lineage(joined.select("k", "y", statistics(F.col("t")).alias("s")))
    values = features(F.col("s"))
    rows = cut_lineage(measured.filter(~base_failed(F.col("s"))).select("k", "y", *(values[f].alias(f) for f in FEATURES)))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []
    ratio = {y: weights[y] / sizes[y] for y in (0, 1)}

    # thresholds halfway between neighbouring quantiles of either class
    quantiles = [i / cuts for i in range(cuts + 1)]
    found = rows.groupBy("y").agg(*(F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES)).collect()
    thresholds = {}
    for f in FEATURES:
        seen = sorted({x for r in found for x in r[f]})
        thresholds[f] = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
    bins = F.array(*(_bin(F.col(f), thresholds[f]) for f in FEATURES))
    weight = F.when(F.col("y") == 0, F.lit(float(ratio[0]))).otherwise(F.lit(float(ratio[1])))
    apart = F.pmod(F.xxhash64("k", F.lit(2)), F.lit(3)) == 0
    left = cut_lineage(rows.select("y", bins.alias("bins"), weight.alias("w"), apart.alias("apart")).coalesce(8))

    def met(condition: tuple[int, bool, int]) -> Column:
        feature, at_least, b = condition
        return F.get("bins", F.lit(feature)) >= b if at_least else F.get("bins", F.lit(feature)) < b

    def both(conditions) -> Column:
        return functools.reduce(lambda a, c: a & met(c), conditions, F.lit(True))

    rules: list[Rule] = []
    open_rows = F.lit(True)
    while len(rules) < max_rules:
        conditions = _grow(left.filter(open_rows & ~F.col("apart")), both, max_conditions)
        kept, precision, seen = _prune(left.filter(open_rows & F.col("apart")), both, conditions)
        if seen < min_support or precision < min_precision:
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], up, thresholds[FEATURES[f]][b - 1]) for f, up, b in kept), precision))
        open_rows = open_rows & ~both(kept)
    return rules


def _bin(value: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: value >= t)) if thresholds else F.lit(0)


def _grow(rows: DataFrame, both, max_conditions: int) -> list[tuple[int, bool, int]]:
    """Add the condition of the largest information gain until no good row is covered."""
    chosen: list[tuple[int, bool, int]] = []
    while len(chosen) < max_conditions:
        counted = rows.filter(both(chosen)).select(F.posexplode("bins").alias("f", "b"), "y", "w").groupBy("f", "b").agg(
            F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("n")
        )
        table: dict[int, dict[int, tuple[float, float]]] = {}
        for r in counted.collect():
            table.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        if not table:
            return chosen
        p0, n0 = (sum(x[i] for x in table[0].values()) for i in (0, 1))
        if n0 <= 1e-9 or p0 <= 1e-9:
            return chosen
        best = (1e-9, None)
        for f in sorted(table):
            p = n = 0.0
            for b in sorted(table[f], reverse=True):
                p, n = p + table[f][b][0], n + table[f][b][1]
                if b:
                    for at_least, a, c in ((True, p, n), (False, p0 - p, n0 - n)):
                        gain = a * (math.log2(a / (a + max(c, 0.0))) - math.log2(p0 / (p0 + n0))) if a > 1e-9 else 0.0
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, at_least, b))
        if best[1] is None:
            return chosen
        chosen.append(best[1])
    return chosen


def _prune(rows: DataFrame, both, conditions: list) -> tuple[list, float, int]:
    """The shortest beginning of the conjunction that does best on rows set apart, its precision and rows there."""
    if not conditions:
        return [], 0.0, 0
    sums = [F.sum(F.when(both(conditions[: i + 1]) & (F.col("y") == y), F.col("w")).otherwise(0.0)) for i in range(len(conditions)) for y in (0, 1)]
    counts = [F.sum(F.when(both(conditions[: i + 1]), 1).otherwise(0)) for i in range(len(conditions))]
    row = [x or 0 for x in rows.agg(*sums, *counts).head()]
    best = (-2.0, 0, 0.0, 0)
    for i in range(len(conditions)):
        p, n, seen = row[2 * i], row[2 * i + 1], row[2 * len(conditions) + i]
        worth = (p - n) / (p + n) if p + n else -2.0
        if worth > best[0] + 1e-9:
            best = (worth, i + 1, p / (p + n), seen)
    return conditions[: best[1]], best[2], best[3]


def verdict(rules: list[Rule], s: Column) -> Column:
    """True unless a rule rejects: the list as one conditional expression, the first rule that holds decides."""
    values = features(s)
    out = None
    for rule in rules:
        out = F.when(rule.column(values), F.lit(False)) if out is None else out.when(rule.column(values), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def keep(rules: list[Rule], text: str = "text") -> Column:
    """Whether a text passes the base rules and the learned ones, as one expression to filter by."""
    return let(statistics(F.col(text)), lambda s: ~base_failed(s) & verdict(rules, s))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", out: str = "_stats") -> DataFrame:
    """``docs`` with the statistics struct ``out`` and the columns base_failed and kept.

    Columns of these names are replaced. A NULL, empty or blank text has no word and fails
    the base rules; repeated rows each get their verdict; an empty table stays empty.
    """
    judged = let(statistics(F.col(text)), lambda s: F.struct(s.alias("s"), base_failed(s).alias("failed"), (~base_failed(s) & verdict(rules, s)).alias("kept")))
    both = docs.withColumn(out, judged)
    return both.withColumns({"base_failed": F.col(out)["failed"], "kept": F.col(out)["kept"], out: F.col(out)["s"]})

"""Isolation forest scores, anomaly flags and their classification against literature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.missing import all_present, number
from statloom.functions.ordered import exact_quantile
from statloom.functions.totals import attach_totals
from statloom.operators.cluster import scaled_columns
from statloom.result import ProfileResult, as_list, numeric_features, quoted, require_columns, require_count
from statloom.session import cut_lineage

TREES, SAMPLE, SEED = 100, 256, 42
OVERSAMPLE = 1.5
# z-score limits per domain, and the one for any other domain (fixed values).
DOMAIN_THRESHOLDS = {"genomics": 3.5, "proteomics": 3.0, "behavioral": 2.5, "geospatial": 3.0}
OTHER_THRESHOLD = 3.0
# Words that classify retrieved text, with class and confidence, in order of precedence.
KEYWORD_CLASSES = [("instrument|calibration", "instrument_error", 0.8), ("noise|artifact", "known_noise", 0.7)]
WITH_SOURCES, WITHOUT_SOURCES, NO_LOOKUP = ("reported_effect", 0.75), ("novel_candidate", 0.6), ("novel_candidate", 0.5)


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(seed: int, sample: int, limit: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """One random isolation tree as flat node arrays, from the sampled rows of a tree."""
        tree = int(rows["tree"].iloc[0])
        rng = np.random.RandomState((seed * 1000 + tree) % 2**31)
        x = np.stack(rows.sort_values("pick")["x"].to_list())[:sample]
        nodes, stack = [], [(np.arange(len(x)), 0, -1, False)]
        while stack:
            members, depth, parent, right = stack.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 if right else 2] = me
            low, high = x[members].min(0), x[members].max(0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or not len(splittable):
                nodes.append([-1, 0.0, -1, -1, depth + average_path(len(members))])
                continue
            f = int(rng.choice(splittable))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append([f, cut, -1, -1, 0.0])
            below = x[members, f] <= cut
            stack.append((members[~below], depth + 1, me, True))
            stack.append((members[below], depth + 1, me, False))
        feature, cut, left, right, length = zip(*nodes)
        return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "down": [left], "up": [right], "length": [length]})

    return build


def _sampled(vectors: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows for every tree: about 1.5 times the sample size, trimmed when a tree is built.

    Equal rows are counted first, and a hash of the values and the tree decides how many of
    them a tree takes, so the draw is the same in every partitioning and in a repeated task.
    """
    per_tree = min(1.0, OVERSAMPLE * sample / n)
    vectors = vectors if "raw" in vectors.columns else vectors.withColumn("raw", F.col("x"))
    share = lambda *c: F.pmod(F.xxhash64(F.lit(seed), F.col("raw"), *c), F.lit(1 << 30)) / float(1 << 30)
    taken = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.floor(F.col("c") * per_tree + share(t)).alias("copies"))
    )
    spread = vectors.groupBy("raw").agg(F.count("*").alias("c"), F.any_value("x").alias("x")).select("raw", "x", F.explode(F.filter(taken, lambda d: d["copies"] > 0)).alias("d"))
    copies = spread.select("raw", "x", "d.tree", F.explode(F.sequence(F.lit(1).cast("long"), F.col("d.copies"))).alias("copy"))
    return copies.select("x", "tree", share("tree", "copy").alias("pick"))


def isolation_scores(df: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> tuple[int, DataFrame]:
    """Complete row count and the input with ``anomaly_score`` (lower is more anomalous).

    Trees grow in parallel from samples of fixed size; the grown trees have a fixed
    bound (trees times sample) and travel to all tasks for scoring.
    """
    n, xs = scaled_columns(df, features)
    require_count(n, 10, "anomaly detection")
    present = all_present(df, features)
    size = min(sample, n)
    limit = math.ceil(math.log2(max(size, 2)))
    # the draw goes by the given values: scaled ones differ in the last bit with the layout
    vectors = df.filter(present).select(F.array(*[number(df, f) for f in features]).alias("raw"), F.array(*xs).alias("x"))
    drawn = cut_lineage(_sampled(vectors, n, trees, size, seed))
    grown = drawn.groupBy("tree").applyInPandas(
        _grow(seed, size, limit),
        "tree int, feature array<int>, cut array<double>, down array<int>, up array<int>, length array<double>",
    )
    forest = [tuple(np.array(r[c]) for c in ("feature", "cut", "down", "up", "length")) for r in grown.orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    base = average_path(size)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_list()) if len(x) else np.zeros((0, len(features)))
        total = np.zeros(len(m))
        for feature, cut, down, up, length in shared.value:
            at = np.zeros(len(m), dtype=int)
            for _ in range(limit):
                f = feature[at]
                below = m[np.arange(len(m)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(below, down[at], up[at]))
            total += length[at]
        return pd.Series(-(2.0 ** (-(total / len(shared.value)) / base)))

    safe = F.array(*[F.coalesce(x, F.lit(0.0)) for x in xs])
    return n, df.withColumn("anomaly_score", F.when(present, score(safe)))


def isolation_forest(
    df: DataFrame, features: list[str] | None = None, contamination: float = 0.05, return_scores: bool = True, seed: int = SEED
) -> ProfileResult:
    """Flag the share of rows that random trees isolate fastest.

    The threshold is the exact contamination quantile of all scores. Rows are written once
    with their scores, so that the trees, by far the dearest part, see every row once.
    """
    features = as_list(features) or numeric_features(df)
    require_columns(df, features=features)
    if df.filter(all_present(df, features)).isEmpty():
        return _no_scores(df, return_scores)
    n, scored = isolation_scores(df, features, seed=seed)
    scored = cut_lineage(scored)
    scores = scored.select("anomaly_score")
    threshold = exact_quantile(scores, "anomaly_score", q=contamination, out="t").first()["t"]
    flag = F.when(F.col("anomaly_score").isNotNull(), F.col("anomaly_score") < F.lit(threshold))
    keep = [quoted(c) for c in df.columns]
    rows = scored.withColumn("is_anomaly", flag).select(*keep, "is_anomaly", *(["anomaly_score"] if return_scores else []))
    found = scores.agg(
        F.count("anomaly_score").alias("rows_used"),
        F.count_if(F.col("anomaly_score").isNull()).alias("rows_excluded"),
        F.count_if(F.col("anomaly_score") < F.lit(threshold)).alias("anomalies_detected"),
    )
    metrics = found.withColumn("anomaly_rate", F.try_divide("anomalies_detected", "rows_used"))
    return ProfileResult(rows, {}, metrics)


def _no_scores(df: DataFrame, return_scores: bool) -> ProfileResult:
    """The result without a complete row: the same columns, no score."""
    extra = {"is_anomaly": F.lit(None).cast("boolean")} | ({"anomaly_score": F.lit(None).cast("double")} if return_scores else {})
    metrics = df.agg(F.lit(0).cast("long").alias("rows_used"), F.count("*").alias("rows_excluded"), F.lit(0).cast("long").alias("anomalies_detected"))
    return ProfileResult(df.withColumns(extra), {}, metrics.withColumn("anomaly_rate", F.lit(None).cast("double")))


def classify_anomalies(
    df: DataFrame, flag: Column, literature: DataFrame | None = None, literature_keys: list[str] | None = None
) -> DataFrame:
    """Class, confidence and citations of flagged rows.

    ``literature`` has the key columns, ``content`` (text) and ``sources`` (array), one
    row per key. Without a row for the key the lookup counts as unavailable.
    """
    keys = as_list(literature_keys)
    staged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    if literature is not None:
        facts = literature.select(*keys, F.lower("content").alias("_content"), F.col("sources").alias("_sources"), F.lit(True).alias("_known"))
        staged = staged.join(facts, keys, "left")
    else:
        staged = staged.withColumns(
            {"_content": F.lit(None).cast("string"), "_sources": F.lit(None).cast("array<string>"), "_known": F.lit(None).cast("boolean")}
        )

    def pick(i: int) -> Column:
        out = F.when(F.col("_known").isNull(), F.lit(NO_LOOKUP[i]))
        for pattern, *value in KEYWORD_CLASSES:
            out = out.when(F.col("_content").rlike(pattern), F.lit(value[i]))
        return out.when(F.size(F.coalesce("_sources", F.array())) > 0, F.lit(WITH_SOURCES[i])).otherwise(F.lit(WITHOUT_SOURCES[i]))

    cited = F.array_join(F.coalesce("_sources", F.array()), "; ")
    return staged.select(
        *[quoted(c) for c in df.columns],
        F.col("_flag").alias("is_anomaly"),
        F.when(F.col("_flag"), pick(0)).otherwise("").alias("anomaly_class"),
        F.when(F.col("_flag"), pick(1)).alias("confidence"),
        F.when(F.col("_flag"), cited).otherwise("").alias("supporting_citations"),
    )


def anomaly_hypothesis(
    df: DataFrame,
    features: list[str],
    domain: str = "genomics",
    contamination: float = 0.05,
    literature: DataFrame | None = None,
    literature_keys: list[str] | None = None,
) -> ProfileResult:
    """Rows whose isolation score lies far below the mean, classified against literature.

    The z-score limit depends on the domain; ``contamination`` is accepted and has no
    effect on the flag.
    """
    features = as_list(features)
    require_columns(df, features=features)
    _, scored = isolation_scores(df, features)
    kept = cut_lineage(scored)
    stats = kept.agg(F.avg("anomaly_score").alias("_m"), F.stddev_pop("anomaly_score").alias("_s"), F.count("*").alias("_n")).first()
    require_count(stats["_n"], 50, "anomaly-hypothesis")
    spread = stats["_s"] if stats["_s"] and stats["_s"] >= 1e-12 else 1.0
    limit = DOMAIN_THRESHOLDS.get(domain, OTHER_THRESHOLD)
    z = (F.col("anomaly_score") - F.lit(stats["_m"])) / F.lit(spread)
    rows = classify_anomalies(kept, z < -limit, literature, literature_keys)
    classes = rows.filter("is_anomaly").groupBy("anomaly_class").agg(F.count("*").alias("n"))
    metrics = attach_totals(
        rows.agg(F.count_if("is_anomaly").alias("anomaly_count")),
        df.sparkSession.range(1).select(F.lit(limit).alias("z_threshold"), F.lit(domain).alias("domain"), F.lit(contamination).alias("contamination")),
    )
    return ProfileResult(rows, {"classifications": classes}, metrics)

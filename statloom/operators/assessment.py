"""Two-parameter item response models: items, abilities, information."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import number
from statloom.result import ProfileResult, as_list, quoted, require_columns, require_rows
from statloom.session import cut_lineage

# Ability grid with standard normal weights (other priors stretch and shift it), and the points of the information curve.
GRID = np.linspace(-4.0, 4.0, 41)
PRIOR = np.exp(-GRID * GRID / 2) / np.exp(-GRID * GRID / 2).sum()
INFORMATION_POINTS = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
MAX_ROUNDS, TOLERANCE = 60, 1e-4
# Patterns whose counts are brought together once; more are folded on the executors in every round.
FEW_PATTERNS = 4096
DISCRIMINATION_RANGE = (0.25, 4.0)
DIFFICULTY_RANGE = (-6.0, 6.0)
STANDARD = "normal(0,1)"
ITEM_SCHEMA = "item string, difficulty double, discrimination double, info_at_zero double"


def prior_scale(prior: str) -> tuple[float, float]:
    """Mean and deviation of a prior written ``normal(mean,deviation)``."""
    found = re.fullmatch(r"\s*normal\(([^,()]+),([^,()]+)\)\s*", prior)
    try:
        mean, deviation = (float(v) for v in found.groups()) if found else (math.nan, math.nan)
    except ValueError:
        mean = deviation = math.nan
    if not (math.isfinite(mean) and 0 < deviation < math.inf):
        raise ValueError(f"ability_prior must read normal(mean,deviation) with a positive deviation, not {prior!r}")
    return mean, deviation


def _probability(a: float, b: float, grid: np.ndarray = GRID) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-a * (grid - b)))


def information(a: float, b: float, theta: float) -> float:
    p = 1.0 / (1.0 + math.exp(-a * (theta - b)))
    return a * a * p * (1 - p)


def _expected(a: np.ndarray, b: np.ndarray):
    """Per batch of patterns: expected persons and correct answers per grid point."""

    def fold(batches):
        p = 1.0 / (1.0 + np.exp(-a[:, None] * (GRID[None, :] - b[:, None])))
        log_p, log_q = np.log(p), np.log1p(-p)
        for batch in batches:
            x = np.stack(batch["x"].to_list()).astype(float)
            like = x @ log_p + (1 - x) @ log_q
            post = np.exp(like - like.max(1, keepdims=True)) * PRIOR
            post = post / post.sum(1, keepdims=True) * batch["n"].to_numpy(float)[:, None]
            counts = np.vstack([post.sum(0), x.T @ post])
            yield pd.DataFrame({"item": np.arange(len(counts)) - 1, "counts": list(counts)})

    return fold


def _rows(folded: pd.DataFrame) -> dict[int, np.ndarray]:
    return dict(zip(folded["item"], folded["counts"]))


def _counts(patterns: DataFrame, a: np.ndarray, b: np.ndarray) -> dict[int, np.ndarray]:
    folded = patterns.mapInPandas(_expected(a, b), "item int, counts array<double>")
    summed = folded.groupBy("item").agg(*[F.sum(F.get("counts", F.lit(j))).alias(f"c{j}") for j in range(len(GRID))])
    return {r["item"]: np.array(r[1:], dtype=float) for r in summed.collect()}  # items + 1 rows


def _improve(a: float, b: float, right: np.ndarray, persons: np.ndarray) -> tuple[float, float]:
    """Newton steps for one item's slope and intercept given the expected counts."""
    slope, offset = a, -a * b
    for _ in range(20):
        p = 1.0 / (1.0 + np.exp(-(slope * GRID + offset)))
        gap, w = right - persons * p, persons * p * (1 - p)
        h = np.array([[(w * GRID * GRID).sum(), (w * GRID).sum()], [(w * GRID).sum(), w.sum()]])
        step = np.linalg.lstsq(h, np.array([(gap * GRID).sum(), gap.sum()]), rcond=None)[0]
        step = np.clip(step, -1.0, 1.0)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    slope = float(np.clip(slope, *DISCRIMINATION_RANGE))
    return slope, float(np.clip(-offset / slope, *DIFFICULTY_RANGE))


def irt_2pl(df: DataFrame, item_columns: list[str], person_id_column: str | None = None, max_rounds: int = MAX_ROUNDS, ability_prior: str = STANDARD) -> ProfileResult:
    """Item difficulty and discrimination by marginal maximum likelihood, and abilities.

    ``ability_prior``, as ``normal(mean,deviation)``, is the distribution of abilities, and
    so the scale of abilities, difficulties and discriminations: items are fitted under the
    standard one and moved to it, which gives the same likelihood. The metrics say in
    ``converged`` whether the last round moved no value by the tolerance.

    Persons with the same answers collapse to one pattern. Each round folds the patterns
    to expected counts per item and grid point; the two-parameter updates work on those
    counts. Up to ``FEW_PATTERNS`` pattern counts, whatever the number of persons, are a
    table the size of the model and are read once; more are folded on the executors.
    """
    items, (mean, deviation) = as_list(item_columns), prior_scale(ability_prior)
    if len(items) < 5:
        raise ValueError("an item response model needs five or more items")
    require_columns(df, item_columns=items)
    require_rows(df, 100, "item response analysis")
    answers = F.array(*[(number(df, c) > 0).cast("int") for c in items])
    # incomplete patterns go after the grouping: a filter of the rows would work out every answer once more
    patterns = cut_lineage(df.groupBy(answers.alias("x")).agg(F.count("*").alias("n"))).filter(F.forall("x", lambda v: v.isNotNull()))
    share = patterns.agg(
        *[(F.sum(F.get("x", F.lit(i)) * F.col("n")) / F.sum("n")).alias(f"p{i}") for i in range(len(items))]
    ).first()
    start = np.clip([share[f"p{i}"] for i in range(len(items))], 0.01, 0.99)
    a, b = np.ones(len(items)), -np.log(start / (1 - start))
    few = patterns.limit(FEW_PATTERNS + 1).toPandas()
    rounds, converged = 0, False
    while rounds < max_rounds and not converged:
        counts = _counts(patterns, a, b) if len(few) > FEW_PATTERNS else _rows(*_expected(a, b)([few]))
        new = [_improve(a[i], b[i], counts[i], counts[-1]) for i in range(len(items))]
        na, nb = np.array([p[0] for p in new]), np.array([p[1] for p in new])
        change = max(np.abs(na - a).max(), np.abs(nb - b).max())
        a, b, rounds, converged = na, nb, rounds + 1, bool(change < TOLERANCE)
    a, b = a / deviation, mean + deviation * b
    spark = df.sparkSession
    parameters = spark.createDataFrame(
        [(c, float(b[i]), float(a[i]), float(information(a[i], b[i], 0.0))) for i, c in enumerate(items)], ITEM_SCHEMA
    )
    metrics = spark.createDataFrame([(len(items), rounds, converged)], "items int, rounds int, converged boolean")
    abilities = eap_abilities(df, {c: (float(a[i]), float(b[i])) for i, c in enumerate(items)}, person_id_column, ability_prior)
    return ProfileResult(abilities, {"item_parameters": parameters, "person_abilities": abilities, "item_information": item_information(parameters)}, metrics)


def eap_abilities(df: DataFrame, items: dict[str, tuple[float, float]], person_id_column: str | None = None, ability_prior: str = STANDARD) -> DataFrame:
    """Posterior mean ability and its deviation per person for known items.

    ``items`` maps a column to (discrimination, difficulty). Everything is one
    expression over literal log-probabilities; missing answers are skipped.
    """
    require_columns(df, item_columns=list(items))
    mean, deviation = prior_scale(ability_prior)
    grid = mean + deviation * GRID
    indices = F.sequence(F.lit(0), F.lit(len(GRID) - 1))

    def log_likelihood(i: Column) -> Column:
        total = F.lit(0.0)
        for c, (a, b) in items.items():
            p = _probability(a, b, grid)
            right, wrong = F.lit([float(v) for v in np.log(p)]), F.lit([float(v) for v in np.log1p(-p)])
            x = number(df, c)
            total = total + F.when(x.isNull(), 0.0).when(x > 0, F.get(right, i)).otherwise(F.get(wrong, i))
        return total

    prior, nodes = F.lit([float(v) for v in PRIOR]), F.lit([float(v) for v in grid])
    scored = df.withColumn("_like", F.transform(indices, log_likelihood)).withColumn("_top", F.array_max("_like"))
    weights = F.transform("_like", lambda v, i: F.exp(v - F.col("_top")) * F.get(prior, i))
    weighed = scored.withColumn("_w", weights).withColumn("_sum", _total("_w"))
    mean = _total(F.zip_with("_w", nodes, lambda w, t: w * t)) / F.col("_sum")
    located = weighed.withColumn("theta", mean)
    variance = _total(F.zip_with("_w", nodes, lambda w, t: w * (t - F.col("theta")) * (t - F.col("theta")))) / F.col("_sum")
    who = [F.col(quoted(person_id_column)).alias("person_id")] if person_id_column else [quoted(c) for c in df.columns]
    return located.withColumn("se", F.sqrt(variance)).select(*who, "theta", "se")


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def item_information(parameters: DataFrame) -> DataFrame:
    """Information a²p(1-p) of each item at the fixed abilities."""
    theta = F.explode(F.lit(INFORMATION_POINTS)).alias("theta")
    a, b = F.col("discrimination"), F.col("difficulty")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-a * (F.col("theta") - b)))
    return parameters.select("item", "discrimination", "difficulty", theta).select("item", "theta", (a * a * p * (1 - p)).alias("information"))

"""Linear and logistic regression, ROC area and classification reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import normal_two_sided
from statloom.functions.missing import all_present, number
from statloom.functions.moments import linear
from statloom.functions.ordered import average_ranks
from statloom.functions.tall import solve, triangular
from statloom.operators.relational import train_test_flag
from statloom.result import ProfileResult, as_list, numeric_features, quoted, require_columns, require_count
from statloom.session import cut_lineage

COEFFICIENTS = "variable string, coefficient double, std_error double, z_score double, p_value double"
PROBABILITY_FLOOR = 1e-10
# A step whose squared length in standard errors is below this share of the rows is the last one.
NEGLIGIBLE_GAIN = 2e-10


def _prepare(df: DataFrame, target: str, features: list[str] | None) -> list[str]:
    features = as_list(features) or numeric_features(df, [target])
    if not features:
        raise ValueError("no numeric feature columns available")
    require_columns(df, target=target, features=features)
    return features


def _designs(df: DataFrame, features: list[str], include_interactions: bool) -> dict[str, Column]:
    design = {f: number(df, f) for f in features}
    if include_interactions:
        for i, a in enumerate(features):
            for b in features[i + 1 :]:
                design[f"{a}_x_{b}"] = number(df, a) * number(df, b)
    return design


def _logit(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _assembled(df: DataFrame, design: dict[str, Column], extra: dict[str, Column]) -> DataFrame:
    names = [f"_f{i}" for i in range(len(design))]
    flat = df.select(*[c.alias(n) for n, c in zip(names, design.values())], *[c.alias(n) for n, c in extra.items()])
    return VectorAssembler(inputCols=names, outputCol="_x").transform(flat).drop(*names)


def _flat(work: DataFrame, design: dict[str, Column], y: Column) -> tuple[DataFrame, list[Column]]:
    """The columns of the design and the outcome, written once for the passes over them."""
    flat = cut_lineage(work.select(*[x.alias(f"_x{i}") for i, x in enumerate(design.values())], y.alias("_y")))
    return flat, [F.col(c) for c in flat.columns]


def _fit_linear(work: DataFrame, design: dict[str, Column], y: Column) -> dict:
    """Least squares by one triangular factor of [1, X, y]."""

    def step(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.hstack([np.ones((len(values), 1)), values]), np.array([float(len(values))])

    r, totals = triangular(work, [*design.values(), y], step)
    n, k = int(totals[0]) if len(totals) else 0, len(design) + 1
    require_count(n, 10, "regression")
    # behind its first row and column stands the factor of the centred table
    slopes, inverse, ssr, _ = solve(r[1:, 1:])
    means = r[0, 1:k] / r[0, 0]
    intercept = float(r[0, k] / r[0, 0] - means @ slopes)
    scale = ssr / (n - k) if n > k else math.nan
    errors = np.sqrt(np.maximum(scale * np.diag(inverse), 0))
    error0 = math.sqrt(max(scale * (1 / n + means @ inverse @ means), 0)) if n > k else math.nan
    return {
        "n": n,
        "intercept": intercept,
        "beta": [float(b) for b in slopes],
        "errors": [error0, *[float(e) for e in errors]],
        "deviance": ssr,
        "null_deviance": float(r[1:, k] @ r[1:, k]),
        "aic": n * math.log(2 * math.pi * ssr / n) + n + 2 * k if ssr > 0 else -math.inf,
        "converged": True,
    }


def _newton(flat: DataFrame, columns: list[Column], max_iter: int) -> dict:
    """Newton steps for a logistic model with intercept, by the factor of the weighted design.

    ``columns`` end with the outcome, a share between 0 and 1. Every round is one pass that
    gives the factor for the next step and the likelihood at the present coefficients; the
    rounds end with a step far below the standard errors.
    """
    beta, rounds, converged = np.zeros(len(columns)), 0, False
    while True:
        r, totals = triangular(flat, columns, _weighted(beta))
        n = int(totals[0]) if len(totals) else 0
        require_count(n, 10, "regression")
        if totals[3]:
            raise ValueError("the outcome of a logistic model has to lie between 0 and 1")
        step, inverse, _, gain = solve(r)
        if converged or rounds == max_iter:
            return {"beta": beta, "inverse": inverse, "n": n, "share": totals[1] / n, "likelihood": totals[2], "converged": converged}
        beta, rounds = beta + step, rounds + 1
        converged = gain <= NEGLIGIBLE_GAIN * n


def _weighted(beta: np.ndarray):
    def step(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.hstack([np.ones((len(values), 1)), values[:, :-1]]), values[:, -1]
        p = np.clip(1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700))), PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
        root = np.sqrt(p * (1 - p))
        likelihood = float(y @ np.log(p) + (1 - y) @ np.log1p(-p))
        outside = float(np.count_nonzero((y < 0) | (y > 1)))
        return np.hstack([x * root[:, None], ((y - p) / root)[:, None]]), np.array([float(len(y)), float(y.sum()), likelihood, outside])

    return step


def _fit_logistic(work: DataFrame, design: dict[str, Column], y: Column) -> dict:
    """Newton steps over the written design."""
    found = _newton(*_flat(work, design, y), 100)
    n, share, beta = found["n"], found["share"], found["beta"]
    deviance = -2.0 * found["likelihood"]
    return {
        "n": n,
        "intercept": float(beta[0]),
        "beta": [float(b) for b in beta[1:]],
        "errors": [float(e) for e in np.sqrt(np.maximum(np.diag(found["inverse"]), 0))],
        "deviance": deviance,
        "null_deviance": -2.0 * n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else 0.0,
        "aic": deviance + 2 * len(beta),
        "converged": found["converged"],
    }


def regression_glm(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    model_type: str = "logistic",
    include_interactions: bool = False,
) -> ProfileResult:
    """Gaussian or binomial GLM with intercept, fitted on complete rows.

    Rows keep their order and count; incomplete ones get NULL predictions. p-values are
    normal-based for both families.
    """
    if model_type not in ("linear", "logistic"):
        raise ValueError("model_type must be 'linear' or 'logistic'")
    features = _prepare(df, target, features)
    design = _designs(df, features, include_interactions)
    y = number(df, target)
    present = all_present(df, [target, *features])
    work = df.filter(present)
    fit = _fit_linear(work, design, y) if model_type == "linear" else _fit_logistic(work, design, y)
    n, k = fit["n"], len(design) + 1
    score = linear(fit["intercept"], fit["beta"], list(design.values()))
    value = score if model_type == "linear" else _logit(score)
    rows = df.withColumn("predicted_value", F.when(present, value)).withColumn(
        "prediction_probability",
        F.col("predicted_value") if model_type == "logistic" else F.lit(None).cast("double"),
    )
    coefficients = []
    for name, b, e in zip(["const", *design], [fit["intercept"], *fit["beta"]], fit["errors"]):
        z = b / e if e and not math.isnan(e) else None
        coefficients.append((name, float(b), float(e), z, normal_two_sided(z)))
    is_linear = model_type == "linear"
    r2 = 1 - fit["deviance"] / fit["null_deviance"] if is_linear and fit["null_deviance"] > 0 else None
    pseudo = None if is_linear else 1 - math.exp((fit["deviance"] - fit["null_deviance"]) / n)
    auc = None
    if not is_linear:
        scored = rows.filter(present).select(number(df, target).alias("y"), "predicted_value")
        auc = roc_auc(scored, "y", "predicted_value").first()["auc"]
    spark = df.sparkSession
    metrics = spark.createDataFrame(
        [
            (
                model_type, n, float(fit["aic"]), float(fit["deviance"] - (n - k) * math.log(n)), r2, pseudo, auc,
                include_interactions, fit["converged"],
            )
        ],
        "model_type string, rows_used long, aic double, bic double, r_squared double, pseudo_r_squared double, "
        "auc double, interactions_applied boolean, converged boolean",
    )
    return ProfileResult(rows, {"coefficients": spark.createDataFrame(coefficients, COEFFICIENTS)}, metrics)


def logistic_irls(df: DataFrame, target: str, features: list[str], max_iter: int = 25) -> ProfileResult:
    """Plain Newton steps for a logistic model with intercept, starting from zero.

    Every step is solved by the triangular factor of the weighted design, which keeps the
    system well conditioned whatever the scales of the features.
    """
    require_columns(df, target=target, features=features)
    y, xs = number(df, target), [number(df, f) for f in features]
    present = all_present(df, [target, *features])
    found = _newton(*_flat(df.filter(present), dict(zip(features, xs)), y), max_iter)
    intercept, raw = float(found["beta"][0]), found["beta"][1:]
    rows = df.withColumn("probability", F.when(all_present(df, features), _logit(linear(intercept, raw, xs))))
    table = [("intercept", intercept), *[(f, float(b)) for f, b in zip(features, raw)]]
    coefficients = df.sparkSession.createDataFrame(table, "variable string, coefficient double")
    return ProfileResult(rows, {"coefficients": coefficients})


def roc_auc(df: DataFrame, label: str, score: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Exact area under the ROC curve by the rank-sum formula, ties averaged.

    Scores are collapsed to (value, positives) counts before the ranking; NULL when a
    class is absent.
    """
    work = df.select(number(df, score).alias("_s"), number(df, label).alias("_l")).dropna()
    ranks = average_ranks(work.select("_s"), "_s", rows_per_bucket=rows_per_bucket)
    positives = work.groupBy("_s").agg(F.sum(F.when(F.col("_l") == 1, 1).otherwise(0)).alias("_p"), F.count("*").alias("_n"))
    joined = positives.join(ranks.select("_s", "avg_rank"), "_s")
    totals = joined.agg(
        F.sum(F.col("_p") * F.col("avg_rank")).alias("r"),
        F.sum("_p").cast("double").alias("p"),
        F.sum(F.col("_n") - F.col("_p")).cast("double").alias("q"),
    )
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return totals.select(area.alias("auc"))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per (label, prediction) pair."""
    return df.groupBy(F.col(quoted(label)).alias("label"), F.col(quoted(prediction)).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with true/false negatives/positives of 0/1 columns."""
    y, p = F.col(quoted(label)), F.col(quoted(prediction))
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negative"),
        F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"),
        F.count_if((y == 1) & (p == 1)).alias("true_positive"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    Works on the confusion counts; a zero denominator gives 0.
    """
    actual = counts.groupBy(F.col("label").cast("string").alias("class")).agg(F.sum("n").alias("support"))
    predicted = counts.groupBy(F.col("prediction").cast("string").alias("class")).agg(F.sum("n").alias("_predicted"))
    hits = counts.filter("cast(label as string) = cast(prediction as string)").groupBy(
        F.col("label").cast("string").alias("class")
    ).agg(F.sum("n").alias("_hits"))
    joined = actual.join(predicted, "class", "full").join(hits, "class", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = joined.withColumns(
        {
            "precision": ratio(F.col("_hits"), F.col("_predicted")),
            "recall": ratio(F.col("_hits"), F.col("support")),
            "f1_score": ratio(2.0 * F.col("_hits"), F.col("_predicted") + F.col("support")),
        }
    )
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    scores = ("precision", "recall", "f1_score")
    summary = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), *[(F.sum("_hits") / total).alias(c) for c in scores], total.alias("support")
            ),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *[weighted(c).alias(c) for c in scores], total.alias("support")),
        ).alias("s")
    ).select(F.inline("s"))
    both = per_class.select("class", *scores, "support").unionByName(summary)
    return both.select("class", *[F.round(c, 4).alias(c) for c in scores], "support")


def regression_logistic(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    threshold: float = 0.5,
    class_weight: str = "balanced",
    test_size: float = 0.2,
    id_columns: list[str] | None = None,
    seed: int = 42,
) -> ProfileResult:
    """L2-regularised (C = 1) logistic regression on z-scaled features.

    Trained on the train rows, scored on all complete rows, evaluated on the test rows.
    The split depends on ``id_columns`` (all used columns by default).
    """
    features = _prepare(df, target, features)
    present = all_present(df, [target, *features])
    work = df.filter(present)
    stats = work.agg(
        F.count("*").alias("n"),
        *[F.avg(number(df, f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(number(df, f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    require_count(stats["n"], 20, "logistic regression")
    classes = [r[0] for r in work.select(F.col(quoted(target))).distinct().limit(3).collect()]
    if len(classes) != 2:
        raise ValueError(f"a logistic target has 2 unique values, not {sorted(map(str, classes))}")
    low, high = sorted(classes)
    y = (F.col(quoted(target)) == F.lit(high)).cast("double")
    scaled = {
        f: (number(df, f) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, f in enumerate(features)
    }
    split = train_test_flag(work, id_columns or [target, *features], test_size, seed, "_test", target)
    train = _assembled(split.filter("not _test"), scaled, {"_y": y})
    counts = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    if class_weight == "balanced":
        weight = F.when(F.col("_y") == 1.0, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", standardization=False, regParam=1.0 / total, maxIter=1000, tol=1e-9
    ).fit(train.withColumn("_w", weight))
    probability = _logit(linear(model.intercept, model.coefficients, list(scaled.values())))
    rows = df.withColumn("predicted_prob", F.when(present, probability)).withColumn(
        "predicted_class", F.when(present, (F.col("predicted_prob") >= threshold).cast("int"))
    )
    tested = (
        train_test_flag(rows.filter(present), id_columns or [target, *features], test_size, seed, "_test", target)
        .filter("_test")
        .withColumn("_y", y)
    )
    ordered = sorted(zip(features, [float(c) for c in model.coefficients]), key=lambda p: -abs(p[1]))
    spark = df.sparkSession
    coefficients = spark.createDataFrame([(f, round(c, 6)) for f, c in ordered], "feature string, coefficient double")
    auc = roc_auc(tested, "_y", "predicted_prob")
    metrics = auc.withColumns(
        {"rows_used": F.lit(stats["n"]), "threshold": F.lit(threshold), "class_weight": F.lit(class_weight), "positive_class": F.lit(str(high)), "negative_class": F.lit(str(low))}
    )
    return ProfileResult(
        rows, {"confusion_matrix": confusion_matrix(tested, "_y", "predicted_class"), "coefficients": coefficients}, metrics
    )

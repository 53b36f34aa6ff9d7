"""Correlations, tests, regressions, survival and causal estimators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from statloom.operators import causal, regression, stats, survival
from tests.helpers import close, rows


@pytest.fixture(scope="module")
def normals(spark):
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"a": rng.randn(80), "b": rng.randn(80)})
    pdf["c"] = pdf["a"] * 2 + rng.randn(80) * 0.5
    pdf.loc[3, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_match_pandas(normals, method):
    pdf, df = normals
    got = stats.correlations(df, method=method).rows.collect()
    want = pdf.dropna().corr(method)
    assert [r["rank"] for r in got] == [1, 2, 3]
    for r in got:
        assert close(r["correlation"], want.loc[r["feature_a"], r["feature_b"]], 1e-9)
    assert got[0]["feature_a"], got[0]["feature_b"] == ("a", "c")
    assert got[0]["p_value"] < 1e-10 < got[2]["p_value"]


def test_many_pairs_use_the_matrix(spark, monkeypatch, normals):
    pdf, df = normals
    monkeypatch.setattr(stats, "MAX_PAIR_EXPRESSIONS", 1)
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in stats.correlations(df).rows.collect()}
    assert close(got[("a", "c")], pdf.dropna().corr().loc["a", "c"], 1e-9)


def test_correlation_errors(spark, normals):
    _, df = normals
    with pytest.raises(ValueError):
        stats.correlations(df, ["a"])
    with pytest.raises(ValueError):
        stats.correlations(df, ["a", "zz"])
    with pytest.raises(ValueError):
        stats.correlations(df.limit(5))


def test_mutual_information_of_copies_is_entropy(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("y"), F.lit(1.0).alias("z"))
    got = {r["feature_a"]: r["correlation"] for r in stats.correlations(df, ["x", "z"], "y", "mutual_info").rows.collect()}
    assert close(got["x"], math.log(4), 1e-9) and close(got["z"], 0.0)


def test_anova_three_groups(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"score": np.concatenate([rng.normal(m, 5, 30) for m in (70, 75, 80)]), "section": ["A"] * 30 + ["B"] * 30 + ["C"] * 30})
    result = stats.anova(spark.createDataFrame(pdf), "score", "section")
    groups = [g["score"].to_numpy() for _, g in pdf.groupby("section")]
    grand = pdf["score"].mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    row = result.metrics.first()
    assert close(row["f_statistic"], round(ssb / 2 / (ssw / 87), 4)) and row["significant"]
    assert close(row["eta_squared"], round(ssb / (ssb + ssw), 4))
    assert result.tables["pairwise"].count() == 3


def test_anova_of_equal_values(spark):
    df = spark.createDataFrame([(1.0, g) for g in "ab" for _ in range(10)], "x double, g string")
    row = stats.anova(df, "x", "g").metrics.first()
    assert row["f_statistic"] is None and row["eta_squared"] == 0.0


def test_too_few_rows_or_groups_are_errors(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], "x", None if i < 8 else "p") for i in range(12)], "x double, g string, one string, few string")
    for group in ("one", "few"):
        with pytest.raises(ValueError):
            stats.anova(df, "x", group)
    with pytest.raises(ValueError):
        stats.anova(df.filter("x < 9"), "x", "g")
    with pytest.raises(ValueError):
        stats.chi_square(df, "few", "g")


def test_chi_square_two_by_two_has_the_correction(spark):
    data = [("yes", 1)] * 30 + [("yes", 0)] * 10 + [("no", 1)] * 50 + [("no", 0)] * 10
    row = stats.chi_square(spark.createDataFrame(data, "pell string, kept int"), "pell", "kept").metrics.first()
    o = np.array([[30, 10], [50, 10]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert close(row["chi2_statistic"], round(((np.abs(o - e) - 0.5) ** 2 / e).sum(), 4))
    assert row["degrees_of_freedom"] == 1 and row["n"] == 100


def test_chi_square_keeps_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 6, "r string, c string")
    result = stats.chi_square(df, "r", "c")
    assert rows(result.tables["observed"], "observed") == [(0.0,), (0.0,), (6.0,), (6.0,)]


def test_glm_linear_matches_least_squares(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(60, 2)
    y = 3 + x @ [1.5, -2.0] + rng.randn(60)
    pdf = pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "y": y})
    pdf.loc[60] = [np.nan, 1.0, 2.0]
    result = regression.regression_glm(spark.createDataFrame(pdf), "y", ["x1", "x2"], "linear")
    design = np.column_stack([np.ones(60), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sigma = ((y - design @ beta) ** 2).sum() / 57
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma)
    for r, b, e in zip(result.tables["coefficients"].collect(), beta, errors):
        assert close(r["coefficient"], b) and close(r["std_error"], e)
    assert result.rows.filter("predicted_value is null").count() == 1


def test_glm_equals_the_library_solver(spark):
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame({"x": rng.randn(50), "z": rng.randn(50)})
    pdf["y"] = 1 + 2 * pdf["x"] + rng.randn(50)
    df = spark.createDataFrame(pdf)
    direct = regression.regression_glm(df, "y", ["x", "z"], "linear")
    data = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df)
    solved = GeneralizedLinearRegression(family="gaussian", featuresCol="v", labelCol="y").fit(data)
    *errors, error0 = solved.summary.coefficientStandardErrors
    for a, b, e in zip(direct.tables["coefficients"].collect(), [solved.intercept, *solved.coefficients], [error0, *errors]):
        assert close(a["coefficient"], b, 1e-6) and close(a["std_error"], e, 1e-6)


def _binary(spark, n=400):
    rng = np.random.RandomState(7)
    x = rng.randn(n)
    y = (rng.rand(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    return pd.DataFrame({"id": range(n), "x": x, "y": y}), spark.createDataFrame(pd.DataFrame({"id": range(n), "x": x, "y": y}))


def test_irls_and_glm_agree(spark):
    _, df = _binary(spark)
    a = {r[0]: r[1] for r in regression.logistic_irls(df, "y", ["x"]).tables["coefficients"].collect()}
    b = {r[0]: r[1] for r in regression.regression_glm(df, "y", ["x"]).tables["coefficients"].collect()}
    assert close(a["intercept"], b["const"], 1e-5) and close(a["x"], b["x"], 1e-5)


def test_logistic_profile(spark):
    _, df = _binary(spark)
    result = regression.regression_logistic(df, "y", ["x"], id_columns=["id"])
    assert result.metrics.first()["auc"] > 0.65
    matrix = result.tables["confusion_matrix"].first()
    assert 40 < sum(matrix) < 120  # about a fifth of the rows is tested
    with pytest.raises(ValueError, match="2 unique values"):
        regression.regression_logistic(df.withColumn("y", F.col("id")), "y", ["x"])


@pytest.mark.parametrize("size", [None, 10])
def test_auc_with_ties(spark, size):
    pdf = pd.DataFrame({"y": [0, 0, 1, 1, 0, 1] * 5, "s": [0.1, 0.4, 0.4, 0.8, 0.8, 0.9] * 5})
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert close(regression.roc_auc(spark.createDataFrame(pdf), "y", "s", size).first()["auc"], want)


@pytest.mark.parametrize("size", [None, 7])
def test_kaplan_meier_by_hand(spark, size):
    data = [(t, e, "a") for t, e in [(1, 1), (2, 0), (3, 1), (3, 1), (4, 0), (5, 1), (5, 0), (6, 1)]] + [(2, 1, "b")] * 3 + [(None, 1, "a")]
    df = spark.createDataFrame(data, "t int, e int, g string")
    result = survival.kaplan_meier(df, "t", "e", "g", rows_per_bucket=size)
    got = {r["timeline"]: r["survival_probability"] for r in result.rows.collect()}
    assert close(got[0.0], 1.0) and close(got[1.0], 7 / 8) and close(got[3.0], 7 / 8 * 4 / 6)
    assert got[6.0] == 0.0
    assert rows(result.tables["groups_skipped"]) == [("b", 3)]
    assert result.tables["median_survival"].first()["median_survival"] == 5.0


def test_kaplan_meier_all_censored(spark):
    df = spark.createDataFrame([(i, 0, "a") for i in range(1, 13)], "t int, e int, g string")
    result = survival.kaplan_meier(df, "t", "e", "g")
    assert {r[0] for r in result.rows.select("survival_probability").collect()} == {1.0}
    assert result.tables["median_survival"].first()["median_survival"] == math.inf


@pytest.mark.parametrize("size", [None, 7])
def test_logrank_three_groups(spark, size):
    rng = np.random.RandomState(1)
    t, e, g = rng.randint(1, 15, 90), rng.randint(0, 2, 90), np.repeat(list("abc"), 30)
    z, v = np.zeros(3), np.zeros((3, 3))
    for u in sorted(set(t[e == 1])):
        risk = np.array([((t >= u) & (g == k)).sum() for k in "abc"], float)
        dead = np.array([((t == u) & (e == 1) & (g == k)).sum() for k in "abc"], float)
        n, d = risk.sum(), dead.sum()
        z += dead - d * risk / n
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(risk / n) - np.outer(risk, risk) / n**2)
    want = z[:2] @ np.linalg.inv(v[:2, :2]) @ z[:2]
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "g": g}))
    got = survival.logrank(df, "t", "e", "g", rows_per_bucket=size).first()
    assert close(got["test_statistic"], want) and got["degrees_of_freedom"] == 2


def test_iv_recovers_the_effect(spark):
    rng = np.random.RandomState(3)
    z = rng.randint(0, 2, 2000)
    u = rng.randn(2000)
    t = ((z + u * 0.5 + rng.randn(2000) * 0.3) > 0.5).astype(float)
    y = 2.0 * t + u + 5
    df = spark.createDataFrame(pd.DataFrame({"y": y, "t": t, "z": z.astype(float), "one": 1.0}))
    row = causal.causal_iv(df, "y", "t", "z", ["one"]).rows.first()
    assert abs(row["iv_estimate"] - 2.0) < 0.3 and row["ci_lower"] < 2.0 < row["ci_upper"]
    assert row["first_stage_f_stat"] > 10 and row["warning"] is None
    weak = causal.causal_iv(df.withColumn("z", F.rand(1)), "y", "t", "z", ["one"]).rows.first()
    assert weak["warning"].startswith("Weak instrument")


def test_rd_jump(spark):
    rng = np.random.RandomState(4)
    r = rng.uniform(-1, 1, 500)
    y = (r >= 0) * 1.0 + rng.randn(500) * 0.05
    t = ((r >= 0) & (rng.rand(500) < 0.8)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "r": r, "t": t}))
    result = causal.causal_rd(df, "y", "r", 0.0, 0.3)
    assert abs(result.rows.first()["late_estimate"] - 1.0) < 0.05
    assert result.tables["bandwidth_sensitivity"].count() == 5
    fuzzy = causal.causal_rd(df, "y", "r", 0.0, 0.3, "fuzzy", "t").rows.first()
    assert fuzzy["late_estimate"] > 1.1
    with pytest.raises(ValueError):
        causal.causal_rd(df, "y", "r", 50.0)


def test_did_recovers_effect_three(spark):
    data = [(i, int(i < 25), str(y), 10.0 + (i < 25) * 2 + (y - 2021) * 0.5 + (3.0 if i < 25 and y >= 2023 else 0.0)) for i in range(50) for y in range(2021, 2025)]
    df = spark.createDataFrame(data, "pid int, treated int, period string, outcome double")
    result = causal.causal_did(df, "outcome", "treated", "period", ["2021", "2022"], ["2023", "2024"])
    row = result.rows.first()
    assert close(row["did_estimate"], 3.0)
    study = {r["period"]: r["coefficient"] for r in result.tables["event_study"].collect()}
    assert close(study["2021"], 0.0) and study["2022"] == 0.0 and close(study["2024"], 3.0)
    with pytest.raises(ValueError, match="binary"):
        causal.causal_did(df, "outcome", "pid", "period", ["2021"], ["2023"])

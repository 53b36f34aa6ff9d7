"""Regressions of any width by one solver: against numpy, with dependent and badly scaled columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.tall import solve, triangular
from statloom.operators import regression


def table(spark, x, y, names):
    rows = [(*map(float, row), float(v)) for row, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"]))


def coefficients(result):
    return {r["variable"]: (r["coefficient"], r["std_error"]) for r in result.tables["coefficients"].collect()}


@pytest.mark.parametrize("width", [11, 32])
def test_a_repeated_column_gives_the_same_fit_at_any_width(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width - 1))
    y = x @ rng.normal(size=width - 1) + rng.normal(size=400) + 5
    names = [f"x{i}" for i in range(width - 1)]
    df = table(spark, x, y, names).withColumn("again", F.col("x0"))
    got = coefficients(regression.regression_glm(df, "y", [*names, "again"], "linear"))
    full = np.hstack([np.ones((400, 1)), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert got["x0"][0] == pytest.approx(beta[1] / 2) and got["again"][0] == pytest.approx(beta[1] / 2)
    assert [got[n][0] for n in names[1:]] == pytest.approx(beta[2:].tolist()) and got["const"][0] == pytest.approx(beta[0])
    assert all(np.isfinite(e) for _, e in got.values())


@pytest.mark.parametrize("width", [3, 45])
def test_logistic_fits_solve_their_score_equations(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(1500, width)) * 10.0 ** rng.integers(-3, 4, width) + 7
    score = (x - x.mean(0)) / x.std(0) @ rng.normal(size=width) * 0.4
    y = (rng.random(1500) < 1 / (1 + np.exp(-score))).astype(float)
    names = [f"x{i}" for i in range(width)]
    df = table(spark, x, y, names).repartition(7)
    result = regression.regression_glm(df, "y", names)
    got = coefficients(result)
    design = np.hstack([np.ones((1500, 1)), x])
    p = 1 / (1 + np.exp(-design @ np.array([got[n][0] for n in ["const", *names]])))
    assert np.abs(design.T @ (y - p) / np.abs(design).sum(0)).max() < 1e-9
    information = np.linalg.inv((design / x.std() * (p * (1 - p))[:, None]).T @ design / x.std())
    assert got["x1"][1] == pytest.approx(np.sqrt(information[2, 2]) / x.std(), rel=1e-4)
    row = result.metrics.first()
    assert row["converged"] and row["aic"] == pytest.approx(-2 * (y @ np.log(p) + (1 - y) @ np.log(1 - p)) + 2 * (width + 1))
    plain = {r[0]: r[1] for r in regression.logistic_irls(df, "y", names).tables["coefficients"].collect()}
    assert [plain[n] for n in names] == pytest.approx([got[n][0] for n in names])


def test_outcomes_outside_the_range_and_separated_ones(spark):
    x = np.arange(20.0).reshape(-1, 1)
    with pytest.raises(ValueError, match="between 0 and 1"):
        regression.regression_glm(table(spark, x, np.full(20, 2.0), ["x"]), "y", ["x"])
    separated = regression.regression_glm(table(spark, x, (x[:, 0] > 9).astype(float), ["x"]), "y", ["x"])
    assert separated.rows.filter("(predicted_value > 0.5) = (y = 1)").count() == 20
    with pytest.raises(ValueError):
        regression.regression_glm(table(spark, x[:4], np.zeros(4), ["x"]), "y", ["x"])


def test_factor_of_many_parts_is_that_of_the_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 5)) + 1e6
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5)))
    columns = [F.col(c) for c in df.columns]
    for parts in (1, 40):
        r, totals = triangular(df.repartition(parts), columns, lambda v: (v, np.array([len(v)], float)))
        assert totals[0] == 700 and np.allclose(np.abs(r), np.abs(np.linalg.qr(x, mode="r")), rtol=1e-6, atol=1e-4)
    assert triangular(df.filter("false"), columns, lambda v: (v, np.zeros(1)))[0].size == 0
    beta, _, rest, _ = solve(np.linalg.qr(np.array([[1.0, 2.0], [2.0, 4.0], [3.0, 6.5]]), mode="r"))
    assert beta[0] == pytest.approx(29.5 / 14) and rest == pytest.approx(62.25 - 29.5**2 / 14)

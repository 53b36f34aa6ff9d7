"""Queries for correlations, tests, regressions, survival and causal estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.ordered import average_ranks
from statloom.operators import causal, regression, stats, survival
from statloom.operators.relational import train_test_flag
from statloom.plans.registry import query, rounded

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rank_sql(columns: list[str], value: str) -> str:
    """Ranked absolute values of named SQL expressions."""
    union = " UNION ALL ".join(columns)
    return f"""SELECT feature_a, feature_b, round({value}, 6) AS correlation,
      CAST(row_number() OVER (ORDER BY abs({value}) DESC) AS INTEGER) AS rank FROM ({union}) WHERE {value} IS NOT NULL"""


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
PEARSON_SQL = _rank_sql(
    [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM d" for a, b in PAIRS], "r"
)
CLEAN = "WITH d AS (SELECT * FROM (SELECT nullif(l_quantity, 50) AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) WHERE l_quantity IS NOT NULL)"


def _gappy(t):
    return t("lineitem").withColumn("l_quantity", F.expr("nullif(l_quantity, 50)"))


@query("e1_correlations", f"{CLEAN} {PEARSON_SQL}")
def _(t):
    return rounded(stats.correlations(_gappy(t), FEATURES).rows.drop("p_value"))


@query("e1_correlations_target", f"""{CLEAN} {_rank_sql(
    [f"SELECT '{a}' AS feature_a, 'l_extendedprice' AS feature_b, corr({a}, l_extendedprice) AS r FROM d"
     for a in FEATURES if a != 'l_extendedprice'], 'r')}""")
def _(t):
    others = [f for f in FEATURES if f != "l_extendedprice"]
    return rounded(stats.correlations(_gappy(t), others, target="l_extendedprice").rows.drop("p_value"))


RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in FEATURES
)


@query("e2_spearman", f"{CLEAN.replace('WITH d', 'WITH raw')}, d AS (SELECT {RANKS} FROM raw) {PEARSON_SQL}")
def _(t):
    return rounded(stats.correlations(_gappy(t), FEATURES, method="spearman").rows.drop("p_value"))


EDGES = {
    "l_quantity": [10, 20, 30, 40],
    "l_extendedprice": [20000, 40000, 60000, 80000],
    "l_discount": [0.015, 0.035, 0.055, 0.075],
}


def _bin_sql(c: str) -> str:
    return " + ".join(f"CAST({c} > {e} AS INTEGER)" for e in EDGES[c])


def _mi_sql(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS feature_a, '{y}' AS feature_b, (
      WITH j AS (SELECT {_bin_sql(x)} AS bx, {_bin_sql(y)} AS bz, count(*) AS n FROM d GROUP BY ALL),
      p AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY bz) AS ny FROM j)
      SELECT sum(n / t * ln(n * t / (nx * ny))) FROM p) AS r"""


@query("e3_mutual_information", f"""{CLEAN} {_rank_sql(
    [_mi_sql(x, 'l_extendedprice') for x in ('l_quantity', 'l_discount')], 'r')}""")
def _(t):
    result = stats.correlations(
        _gappy(t), ["l_quantity", "l_discount"], target="l_extendedprice", method="mutual_info", bin_edges=EDGES
    )
    return rounded(result.rows.drop("p_value"))


GROUPS = "g AS (SELECT o_orderpriority AS grp, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("e4_anova", f"""
WITH {GROUPS}, t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT max(t.n) AS n, max(t.k) AS k, sum(g.n * (m - grand) ** 2) AS ssb, sum((g.n - 1) * v) AS ssw FROM g, t),
f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM s),
x AS (SELECT *, (n - k) / ((n - k) + (k - 1) * f) AS x FROM f)
SELECT CAST(k AS BIGINT) AS n_groups, CAST(n AS BIGINT) AS rows_used, round(f, 4) AS f_statistic,
       round(x ** ((n - k) / 2) * (1 + (n - k) / 2 * (1 - x)), 6) AS p_value,
       round(ssb / (ssb + ssw), 4) AS eta_squared,
       x ** ((n - k) / 2) * (1 + (n - k) / 2 * (1 - x)) < 0.05 AS significant, 0.05::DOUBLE AS alpha FROM x""")
def _(t):
    return stats.anova(t("orders"), "o_totalprice", "o_orderpriority").tables["anova_table"]


@query("e5_pairwise", f"""
WITH {GROUPS}
SELECT a.grp AS group1, b.grp AS group2, round(a.m - b.m, 4) AS mean_diff,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t_statistic,
  round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS degrees_of_freedom
FROM g a JOIN g b ON a.grp < b.grp""")
def _(t):
    table = stats.anova(t("orders"), "o_totalprice", "o_orderpriority").tables["pairwise"]
    return rounded(table.drop("p_value", "significant"), 4)


def t_tail_sql(t: str, dof: str) -> str:
    """Two-sided tail of Student's distribution, its density summed by Simpson's rule in 400 steps."""
    density = f"(1 + (i * {t} / 400.0::DOUBLE) ** 2 / {dof}) ** (-({dof} + 1) / 2)"
    factor = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inside = f"list_sum(list_transform(range(401), lambda i: {factor} * {density})) * {t} / 1200"
    return f"(1 - 2 * {inside} * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi()))"


@query("e5_pairwise_pvalues", f"""
WITH {GROUPS},
w AS (SELECT a.grp AS group1, b.grp AS group2, a.m - b.m AS gap, a.v / a.n AS va, b.v / b.n AS vb, a.n AS na, b.n AS nb, (SELECT count(*) FROM g) AS k FROM g a JOIN g b ON a.grp < b.grp),
t AS (SELECT *, gap / sqrt(va + vb) AS t, abs(gap) / sqrt(va + vb) AS size, (va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)) AS dof FROM w),
p AS (SELECT *, least({t_tail_sql("size", "dof")} * k * (k - 1) / 2, 1) AS p FROM t)
SELECT group1, group2, round(gap, 4) AS mean_diff, round(t, 6) AS t_statistic, round(dof, 4) AS degrees_of_freedom, round(p, 6) AS p_value, p < 0.05 AS significant FROM p""")
def _(t):
    table = stats.anova(t("orders"), "o_totalprice", "o_orderpriority").tables["pairwise"]
    return rounded(table, 6, mean_diff=4, degrees_of_freedom=4)


@query("e6_group_summary", f"""
WITH {GROUPS} SELECT grp AS "group", n, round(m, 4) AS mean, round(sqrt(v), 4) AS std FROM g""")
def _(t):
    return rounded(stats.anova(t("orders"), "o_totalprice", "o_orderpriority").tables["group_summary"], 4)


def _chi_sql(source: str, r: str, c: str, weight: str, yates: bool, tail: str) -> str:
    gap = "greatest(abs(o - e) - 0.5, 0)" if yates else "abs(o - e)"
    return f"""
WITH cells AS (SELECT {r} AS r, {c} AS c, sum({weight}) AS o, count(*) AS k FROM {source} GROUP BY ALL),
rs AS (SELECT r, sum(o) AS ro FROM cells GROUP BY r), cs AS (SELECT c, sum(o) AS co FROM cells GROUP BY c),
n AS (SELECT sum(o) AS n FROM cells),
full_grid AS (SELECT r, c, coalesce(o, 0) AS o, ro * co / n AS e, n FROM (SELECT * FROM rs, cs, n) LEFT JOIN cells USING (r, c)),
x AS (SELECT sum({gap} ** 2 / e) AS x, max(n) AS n, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof,
      least(count(DISTINCT r), count(DISTINCT c)) - 1 AS d FROM full_grid)
{tail}"""


CHI_TAIL = """
, v AS (SELECT *, sqrt(x / (floor(n) * d)) AS v FROM x)
SELECT CAST(floor(n) AS BIGINT) AS n, round(x, 4) AS chi2_statistic, dof AS degrees_of_freedom, round(v, 4) AS cramers_v,
  CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS effect_size FROM v"""


@query("e7_chi_square", _chi_sql("orders", "o_orderstatus", "o_orderpriority", "1.0::DOUBLE", False, CHI_TAIL.replace(
    "SELECT CAST(floor(n)", "SELECT round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6), 6) AS p_value, CAST(floor(n)")))
def _(t):
    table = stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority").tables["test_statistics"]
    return table.drop("significant", "alpha")


@query("e7_chi_square_weighted", _chi_sql("orders", "o_orderstatus", "o_orderpriority", "o_totalprice", False, CHI_TAIL))
def _(t):
    table = stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice").tables["test_statistics"]
    return table.drop("significant", "alpha", "p_value")


@query("e7_chi_square_2x2", _chi_sql("lineitem", "l_returnflag = 'R'", "l_linestatus", "1.0::DOUBLE", True, CHI_TAIL))
def _(t):
    li = t("lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return stats.chi_square(li, "returned", "l_linestatus").tables["test_statistics"].drop("significant", "alpha", "p_value")


@query("e8_observed", _chi_sql("orders", "o_orderstatus", "o_orderpriority", "1.0::DOUBLE", False,
                               "SELECT r AS row_value, c AS col_value, o AS observed FROM full_grid"))
def _(t):
    return stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority").tables["observed"]


@query("e8_expected", _chi_sql("orders", "o_orderstatus", "o_orderpriority", "1.0::DOUBLE", False,
                               "SELECT r AS row_value, c AS col_value, round(e, 6) AS expected FROM full_grid"))
def _(t):
    return rounded(stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority").tables["expected"])


@query("e8_observed_wide", """
SELECT o_orderstatus AS row_value, count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE AS "1-URGENT",
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH')::DOUBLE AS "2-HIGH", count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM')::DOUBLE AS "3-MEDIUM",
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED')::DOUBLE AS "4-NOT SPECIFIED",
  count(*) FILTER (WHERE o_orderpriority = '5-LOW')::DOUBLE AS "5-LOW" FROM orders GROUP BY 1""")
def _(t):
    table = stats.chi_square(t("orders"), "o_orderstatus", "o_orderpriority").tables["observed"]
    return stats.contingency_wide(table, "observed")


# --- regression -------------------------------------------------------------------------


@query("f1_linear_predictions", """
WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(i + s * l_quantity, 4) AS predicted_value FROM lineitem, b""")
def _(t):
    rows = regression.regression_glm(t("lineitem"), "l_extendedprice", ["l_quantity"], "linear").rows
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "predicted_value"), 4)


@query("f1_linear_two_features", """
WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_discount, l_discount) AS bb,
  covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS cy,
  avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
s AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS b1, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT 'const' AS variable, round(my - b1 * ma - b2 * mb, 4) AS coefficient FROM s
UNION ALL SELECT 'l_quantity', round(b1, 4) FROM s UNION ALL SELECT 'l_discount', round(b2, 4) FROM s""")
def _(t):
    result = regression.regression_glm(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "linear")
    return rounded(result.tables["coefficients"].select("variable", "coefficient"), 4)


@query("f1_linear_repeated_columns", """
WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT 'const' AS variable, round(i, 3) AS coefficient FROM b
UNION ALL SELECT 'q' || lpad(k::VARCHAR, 2, '0'), round(s / 40, 3) FROM b, range(40) r(k)""")
def _(t):
    """Forty copies of one regressor share its effect, as two would."""
    names = [f"q{k:02d}" for k in range(40)]
    wide = t("lineitem").select("l_extendedprice", *[F.col("l_quantity").alias(c) for c in names])
    return rounded(regression.regression_glm(wide, "l_extendedprice", names, "linear").tables["coefficients"].select("variable", "coefficient"), 3)


@query("f2_logistic_predictions", """
WITH r AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(p, 5) AS prediction_probability FROM lineitem JOIN r USING (l_linestatus)""")
def _(t):
    rows = regression.regression_glm(_binary(t), "returned", ["is_f"], "logistic").rows
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "prediction_probability"), 5)


def _binary(t):
    return t("lineitem").withColumns(
        {
            "returned": (F.col("l_returnflag") == "R").cast("int"),
            "is_f": (F.col("l_linestatus") == "F").cast("int"),
        }
    )


@query("f3_interactions", """
WITH g AS (SELECT l_returnflag = 'R' AS a, l_linestatus = 'F' AS b, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL),
c AS (SELECT max(m) FILTER (WHERE NOT a AND NOT b) AS m00, max(m) FILTER (WHERE a AND NOT b) AS m10,
             max(m) FILTER (WHERE NOT a AND b) AS m01, max(m) FILTER (WHERE a AND b) AS m11 FROM g)
SELECT 'const' AS variable, round(m00, 4) AS coefficient FROM c
UNION ALL SELECT 'returned', round(m10 - m00, 4) FROM c UNION ALL SELECT 'is_f', round(m01 - m00, 4) FROM c
UNION ALL SELECT 'returned_x_is_f', round(m11 - m10 - m01 + m00, 4) FROM c""")
def _(t):
    result = regression.regression_glm(_binary(t), "l_extendedprice", ["returned", "is_f"], "linear", include_interactions=True)
    return rounded(result.tables["coefficients"].select("variable", "coefficient"), 4)


LINE_FIT = """
WITH b AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
  avg(l_quantity) AS mx FROM lineitem),
e AS (SELECT *, syy - s * s * sxx AS ssr, (syy - s * s * sxx) / (n - 2) AS scale FROM b)"""


@query("f4_coefficients", LINE_FIT + """
SELECT 'const' AS variable, round(i, 3) AS coefficient, round(sqrt(scale * (1.0 / n + mx * mx / sxx)), 3) AS std_error,
       round(i / sqrt(scale * (1.0 / n + mx * mx / sxx)), 3) AS z_score FROM e
UNION ALL SELECT 'l_quantity', round(s, 3), round(sqrt(scale / sxx), 3), round(s / sqrt(scale / sxx), 3) FROM e""")
def _(t):
    result = regression.regression_glm(t("lineitem"), "l_extendedprice", ["l_quantity"], "linear")
    return rounded(result.tables["coefficients"].drop("p_value"), 3)


@query("f5_linear_fit", LINE_FIT + """
SELECT n AS rows_used, round(n * ln(2 * pi() * ssr / n) + n + 4, 2) AS aic, round((ssr - (n - 2) * ln(n)) / 1e6, 2) AS bic_millions,
       round(1 - ssr / syy, 6) AS r_squared FROM e""")
def _(t):
    m = regression.regression_glm(t("lineitem"), "l_extendedprice", ["l_quantity"], "linear").metrics
    return m.select(
        "rows_used", F.round("aic", 2).alias("aic"), F.round(F.col("bic") / 1e6, 2).alias("bic_millions"), F.round("r_squared", 6).alias("r_squared")
    )


@query("f5_logistic_fit", """
WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END AS y, l_linestatus AS g FROM lineitem),
r AS (SELECT g, count(*) AS n, sum(y) AS s, avg(y) AS p FROM d GROUP BY g),
t AS (SELECT sum(n) AS n, sum(s) AS s, sum(s) / sum(n) AS p, -2 * sum(s * ln(p) + (n - s) * ln(1 - p)) AS dev FROM r),
f AS (SELECT *, -2 * (s * ln(p) + (n - s) * ln(1 - p)) AS nulldev FROM t)
SELECT CAST(n AS BIGINT) AS rows_used, round(dev + 4, 3) AS aic, round(dev - (n - 2) * ln(n), 3) AS bic,
       round(1 - exp((dev - nulldev) / n), 6) AS pseudo_r_squared FROM f""")
def _(t):
    m = regression.regression_glm(_binary(t), "returned", ["is_f"], "logistic").metrics
    return m.select(
        "rows_used", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("pseudo_r_squared", 6).alias("pseudo_r_squared")
    )


@query("f6_regression_logistic")
def _(t):
    df = t("lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    result = regression.regression_logistic(df, "returned", ["l_quantity", "l_extendedprice", "l_discount"])
    return result.rows.select("l_orderkey", "l_linenumber", "predicted_prob", "predicted_class")


# At the maximum of the penalised likelihood the weighted gaps of the train rows, times each
# scaled feature, are outweighed by its coefficient.
@query("f6_score_equations", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, true AS met FROM (SELECT count(*) FROM lineitem)")
def _(t):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    df = t("lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    ids = ["l_orderkey", "l_linenumber"]
    result = regression.regression_logistic(df, "returned", features, id_columns=ids)
    scale = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    train = train_test_flag(result.rows, ids, 0.2, 42, "held", "returned").filter("not held")
    sizes = train.groupBy("returned").agg(F.count("*").alias("_class")).join(train.agg(F.count("*").alias("_all")))
    weighed = train.join(F.broadcast(sizes), "returned").join(F.broadcast(scale)).withColumn("gap", F.col("_all") / (2 * F.col("_class")) * (F.col("returned") - F.col("predicted_prob")))
    pulls = weighed.agg(*[F.avg(F.col("gap") * (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(f) for f in features], F.count("*").alias("n"))
    long = pulls.unpivot(["n"], features, "feature", "pull")
    gap = F.col("pull") - F.col("coefficient") / F.col("n")
    return long.join(result.tables["coefficients"], "feature").select("feature", (F.abs(gap) < 1e-6).alias("met"))


def _fixed_predictions(t):
    """Status against a rule on the ship date, as a stand-in for model output."""
    return t("lineitem").select(
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_quantity") > 25).cast("int").alias("prediction"),
        F.col("l_returnflag").alias("actual_flag"),
        F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("predicted_flag"),
        F.col("l_extendedprice").alias("score"),
    )


@query("f7_confusion_matrix", """
SELECT count(*) FILTER (WHERE l_linestatus <> 'F' AND l_quantity <= 25) AS true_negative,
  count(*) FILTER (WHERE l_linestatus <> 'F' AND l_quantity > 25) AS false_positive,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity <= 25) AS false_negative,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 25) AS true_positive FROM lineitem""")
def _(t):
    return regression.confusion_matrix(_fixed_predictions(t), "label", "prediction")


@query("f8_roc_auc", """
WITH d AS (SELECT (l_linestatus = 'F') AS y, l_quantity AS s FROM lineitem),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d),
t AS (SELECT sum(r) FILTER (WHERE y) AS rs, (count(*) FILTER (WHERE y))::DOUBLE AS p, (count(*) FILTER (WHERE NOT y))::DOUBLE AS q FROM r)
SELECT round((rs - p * (p + 1) / 2) / (p * q), 8) AS auc FROM t""")
def _(t):
    df = t("lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("label"), "l_quantity")
    return rounded(regression.roc_auc(df, "label", "l_quantity"), 8)


@query("f11_classification_report", """
WITH d AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem),
a AS (SELECT y AS class, count(*) AS support FROM d GROUP BY 1), b AS (SELECT p AS class, count(*) AS pr FROM d GROUP BY 1),
h AS (SELECT y AS class, count(*) AS hits FROM d WHERE y = p GROUP BY 1),
c AS (SELECT class, support, pr, coalesce(hits, 0) AS hits, coalesce(hits, 0) / pr AS precision, coalesce(hits, 0) / support AS recall,
      2 * coalesce(hits, 0) / (pr + support) AS f1 FROM a JOIN b USING (class) LEFT JOIN h USING (class)),
u AS (SELECT class, precision, recall, f1, support FROM c
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM c
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM c)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1_score, CAST(support AS BIGINT) AS support FROM u""")
def _(t):
    counts = regression.confusion_counts(_fixed_predictions(t), "actual_flag", "predicted_flag")
    return regression.classification_report(counts)


@query("f13_logistic_irls", """
WITH r AS (SELECT l_linestatus = 'F' AS f, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS p FROM lineitem GROUP BY 1),
c AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE NOT f) AS a, max(ln(p / (1 - p))) FILTER (WHERE f) AS b FROM r)
SELECT 'intercept' AS variable, round(a, 6) AS coefficient FROM c UNION ALL SELECT 'is_f', round(b - a, 6) FROM c""")
def _(t):
    return rounded(regression.logistic_irls(_binary(t), "returned", ["is_f"]).tables["coefficients"])


@query("u1_average_ranks", """
SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank
FROM lineitem""")
def _(t):
    return average_ranks(t("lineitem"), "l_quantity", ["l_returnflag"]).drop("below")


# --- survival ---------------------------------------------------------------------------


def _durations(t):
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.datediff("l_shipdate", "o_orderdate").alias("duration"),
            (F.col("l_returnflag") == "R").cast("int").alias("event"),
            F.col("o_orderpriority").alias("grp"),
            F.col("l_linestatus").alias("status"),
        )
    )


DURATIONS = """d AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS t,
  CAST(l_returnflag = 'R' AS INTEGER) AS e, {g} AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) >= 0)"""

KM = "WITH " + DURATIONS.format(g="o_orderpriority") + """,
c0 AS (SELECT g, t, count(*) AS n, sum(e) AS d FROM d GROUP BY ALL UNION ALL SELECT DISTINCT g, 0.0, 0, 0 FROM d),
c AS (SELECT g, t, sum(n) AS n, CAST(sum(d) AS BIGINT) AS d FROM c0 GROUP BY ALL),
r AS (SELECT g, t, d, CAST(sum(n) OVER (PARTITION BY g) - coalesce(sum(n) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM c),
s AS (SELECT *, CASE WHEN sum(CASE WHEN d > 0 AND d >= n THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
         ELSE exp(sum(CASE WHEN d > 0 AND d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS s,
       sum(CASE WHEN d > 0 AND d < n THEN d / (n * (n - d)) ELSE 0 END) OVER w AS v
  FROM r WINDOW w AS (PARTITION BY g ORDER BY t))"""


@query("i1_kaplan_meier", KM + """
SELECT g AS "group", t AS timeline, round(s, 6) AS survival_probability, n AS at_risk, d AS events FROM s""")
def _(t):
    rows = survival.kaplan_meier(_durations(t), "duration", "event", "grp", log_rank=False).rows
    return rounded(rows.drop("survival_lower", "survival_upper"))


@query("i2_confidence_bands", KM + """
SELECT g AS "group", t AS timeline,
  round(CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(v) / ln(s))) ELSE s END, 6) AS survival_lower,
  round(CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(v) / ln(s))) ELSE s END, 6) AS survival_upper FROM s""")
def _(t):
    rows = survival.kaplan_meier(_durations(t), "duration", "event", "grp", log_rank=False).rows
    return rounded(rows.select("group", "timeline", "survival_lower", "survival_upper"))


@query("i3_median_survival", KM + """
SELECT g AS "group", coalesce(min(t) FILTER (WHERE s <= 0.5), 'infinity'::DOUBLE) AS median_survival FROM s GROUP BY g""")
def _(t):
    return survival.kaplan_meier(_durations(t), "duration", "event", "grp", log_rank=False).tables["median_survival"]


@query("i4_logrank", "WITH " + DURATIONS.format(g="l_linestatus") + """,
c AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE g = 'F') AS n1, sum(e) AS d, coalesce(sum(e) FILTER (WHERE g = 'F'), 0) AS d1 FROM d GROUP BY t),
r AS (SELECT d, d1, sum(n) OVER w AS n, sum(n1) OVER w AS n1 FROM c WINDOW w AS (ORDER BY t DESC)),
z AS (SELECT sum(d1 - d * n1 / n) AS z, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT round(z * z / v, 6) AS test_statistic, 1 AS degrees_of_freedom FROM z""")
def _(t):
    return rounded(survival.logrank(_durations(t), "duration", "event", "status").drop("p_value", "significant"))


@query("i4_logrank_groups")
def _(t):
    return survival.logrank(_durations(t), "duration", "event", "grp")


# --- causal -----------------------------------------------------------------------------


def _iv(t):
    return t("lineitem").select(
        "l_extendedprice",
        (F.col("l_quantity") > 25).cast("double").alias("treated"),
        ((F.col("l_quantity") + F.col("l_partkey") % 20) > 25).cast("double").alias("offered"),
        "l_discount",
    )


IV = "d AS (SELECT l_extendedprice AS y, CAST(l_quantity > 25 AS DOUBLE) AS t, CAST(l_quantity + l_partkey % 20 > 25 AS DOUBLE) AS z, l_discount AS c FROM lineitem)"


@query("k1_iv_estimate", f"""
WITH {IV}, b AS (SELECT sum(z * y) / sum(z * t) AS b, sum(z * t) AS zt FROM d),
e AS (SELECT max(b) AS b, sqrt(sum((y - b * t) ** 2 * z * z)) / max(zt) AS se FROM d, b)
SELECT round(b, 4) AS iv_estimate, round(se, 4) AS std_error, round(b - 1.959963984540054 * se, 4) AS ci_lower,
       round(b + 1.959963984540054 * se, 4) AS ci_upper FROM e""")
def _(t):
    rows = causal.causal_iv(_iv(t), "l_extendedprice", "treated", "offered").rows
    return rounded(rows.select("iv_estimate", "std_error", "ci_lower", "ci_upper"), 4)


@query("k1_iv_with_controls", f"""
WITH {IV}, s AS (SELECT sum(c * c) AS cc, sum(c * z) AS cz, sum(c * t) AS ct, sum(z * t) AS zt, sum(c * y) AS cy, sum(z * y) AS zy FROM d)
SELECT round((cc * zy - cz * cy) / (cc * zt - cz * ct), 4) AS iv_estimate FROM s""")
def _(t):
    return rounded(causal.causal_iv(_iv(t), "l_extendedprice", "treated", "offered", ["l_discount"]).rows.select("iv_estimate"), 4)


@query("k2_first_stage", f"""
WITH {IV}, b AS (SELECT sum(z * t) / sum(z * z) AS p, sum(z * z) AS zz FROM d),
f AS (SELECT max(p) ** 2 / (sum((t - p * z) ** 2 * z * z) / max(zz) ** 2) AS f FROM d, b)
SELECT round(f, 4) AS first_stage_f_stat,
  CASE WHEN f < 10 THEN 'Weak instrument: first-stage F-statistic is ' || printf('%.2f', f) || ' (threshold: 10)' END AS warning FROM f""")
def _(t):
    rows = causal.causal_iv(_iv(t), "l_extendedprice", "treated", "offered").rows
    return rounded(rows.select("first_stage_f_stat", "warning"), 4)


@query("k3_compliance", f"""
WITH {IV} SELECT round(count(*) FILTER (WHERE t = 1 AND z = 1) / greatest(count(*) FILTER (WHERE z = 1), 1), 8) AS compliance_rate FROM d""")
def _(t):
    return rounded(causal.causal_iv(_iv(t), "l_extendedprice", "treated", "offered").rows.select("compliance_rate"), 8)


RD = """WITH h AS (SELECT 2.702 * stddev_samp(l_quantity) * count(*) ** (-0.2) AS h FROM lineitem)"""


def _rd_mean(f: str) -> str:
    return f"""(SELECT avg(l_extendedprice) FILTER (WHERE l_quantity >= 25 AND l_quantity <= 25 + h * {f})
      - avg(l_extendedprice) FILTER (WHERE l_quantity >= 25 - h * {f} AND l_quantity < 25) FROM lineitem, h)"""


@query("k4_rd_sharp", f"{RD} SELECT round({_rd_mean('1.0')}, 4) AS late_estimate, round(h, 4) AS bandwidth_used FROM h")
def _(t):
    rows = causal.causal_rd(t("lineitem"), "l_extendedprice", "l_quantity", 25).rows
    return rounded(rows.select("late_estimate", "bandwidth_used"), 4)


@query("k5_rd_sensitivity", RD + " UNION ALL ".join(
    f" SELECT round(h * {f}, 4) AS bandwidth, round({_rd_mean(f)}, 4) AS estimate FROM h" for f in ("0.5", "0.75", "1.0", "1.25", "1.5")))
def _(t):
    return rounded(causal.causal_rd(t("lineitem"), "l_extendedprice", "l_quantity", 25).tables["bandwidth_sensitivity"], 4)


@query("k6_rd_density", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, greatest(10, CAST(floor(sqrt(count(*))) AS BIGINT)) AS k FROM lineitem),
bins AS (SELECT unnest(range(k)) AS bin, lo, (hi - lo) / k AS w, k FROM b),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / k)) AS BIGINT), k - 1) AS bin, count(*) AS n FROM lineitem, b GROUP BY ALL),
f AS (SELECT lo + (bin + 0.5) * w >= 40000 AS above, coalesce(n, 0) AS n FROM bins LEFT JOIN c USING (bin))
SELECT round(abs(avg(n) FILTER (WHERE above) - avg(n) FILTER (WHERE NOT above)), 6) AS mccrary_statistic FROM f""")
def _(t):
    rows = causal.causal_rd(t("lineitem"), "l_tax", "l_extendedprice", 40000.0).rows
    return rounded(rows.select("mccrary_statistic"))


@query("k7_rd_fuzzy", """
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS r, CAST(l_quantity + l_partkey % 20 > 30 AS DOUBLE) AS t FROM lineitem WHERE l_quantity BETWEEN 15 AND 35),
m AS (SELECT avg(y) FILTER (WHERE r >= 25) AS y1, avg(y) FILTER (WHERE r < 25) AS y0, avg(t) FILTER (WHERE r >= 25) AS t1, avg(t) FILTER (WHERE r < 25) AS t0 FROM d)
SELECT round((y1 - y0) / (t1 - t0), 4) AS late_estimate FROM m""")
def _(t):
    df = t("lineitem").withColumn("takeup", (F.col("l_quantity") + F.col("l_partkey") % 20 > 30).cast("double"))
    rows = causal.causal_rd(df, "l_extendedprice", "l_quantity", 25, 10, "fuzzy", "takeup").rows
    return rounded(rows.select("late_estimate"), 4)


PRE, POST = [1995, 1996, 1997], [1998, 1999, 2000]


def _did(t):
    df = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_totalprice",
            (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"),
            F.year("o_orderdate").alias("year"),
        )
    )
    return causal.causal_did(df, "o_totalprice", "treated", "year", PRE, POST)


DID = """WITH d AS (SELECT o_totalprice AS y, c_mktsegment = 'BUILDING' AS t, year(o_orderdate) AS p FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _cell_sql(after: str, before: str, base: str = "d") -> str:
    cells = {"a1": f"t AND {after}", "a0": f"NOT t AND {after}", "b1": f"t AND {before}", "b0": f"NOT t AND {before}"}
    means = ", ".join(f"avg(y) FILTER (WHERE {w}) AS m{k}, var_pop(y) FILTER (WHERE {w}) AS v{k}, count(*) FILTER (WHERE {w}) AS n{k}" for k, w in cells.items())
    return f"""SELECT (ma1 - mb1) - (ma0 - mb0) AS c, sqrt(va1 / na1 + va0 / na0 + vb1 / nb1 + vb0 / nb0) AS s,
      na1 + na0 + nb1 + nb0 AS n FROM (SELECT {means} FROM {base})"""


@query("k8_did", DID + f"""
SELECT round(c, 4) AS did_estimate, round(s, 4) AS std_error, round(c - 1.96 * s, 4) AS ci_lower, round(c + 1.96 * s, 4) AS ci_upper,
       n AS rows_used FROM ({_cell_sql("p IN (1998, 1999, 2000)", "p NOT IN (1998, 1999, 2000)")})""")
def _(t):
    return rounded(_did(t).rows.drop("parallel_trends_pvalue"), 4)


@query("k9_parallel_trends", DID + f""",
c AS (SELECT avg(y) FILTER (WHERE t) - avg(y) FILTER (WHERE NOT t) AS gap, count(*) FILTER (WHERE t) - 1 AS f1, count(*) FILTER (WHERE NOT t) - 1 AS f0,
  var_pop(y) FILTER (WHERE t) AS v1, var_pop(y) FILTER (WHERE NOT t) AS v0 FROM d WHERE p IN (1995, 1996, 1997)),
w AS (SELECT abs(gap) / sqrt(v1 / f1 + v0 / f0) AS size, (v1 / f1 + v0 / f0) ** 2 / ((v1 / f1) ** 2 / f1 + (v0 / f0) ** 2 / f0) AS dof FROM c)
SELECT round({t_tail_sql("size", "dof")}, 6) AS parallel_trends_pvalue FROM w""")
def _(t):
    return rounded(_did(t).rows.select("parallel_trends_pvalue"))


@query("k10_event_study", DID + " UNION ALL ".join(
    [" SELECT '1997' AS period, 0.0::DOUBLE AS coefficient, 0.0::DOUBLE AS ci_lower, 0.0::DOUBLE AS ci_upper, true AS base"]
    + [f" SELECT '{p}', round(c, 4), round(c - 1.96 * s, 4), round(c + 1.96 * s, 4), false FROM ({_cell_sql(f'p = {p}', 'p = 1997')})"
       for p in (1995, 1996, 1998, 1999, 2000)]))
def _(t):
    return rounded(_did(t).tables["event_study"], 4)


@query("k11_placebo", DID + " UNION ALL ".join(
    f" SELECT '{p}' AS period, round(c, 4) AS estimate FROM ({_cell_sql(f'p = {p}', f'p IN (1995, 1996, 1997) AND p <> {p}')})"
    for p in (1995, 1996)))
def _(t):
    return rounded(_did(t).tables["placebo"].drop("p_value"), 4)

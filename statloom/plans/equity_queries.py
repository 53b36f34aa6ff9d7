"""Queries for group gaps, rates, benchmarking, aid, retention and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import cohort, equity
from statloom.plans.registry import query, rounded

GAP = """
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1),
r AS (SELECT max(m) FILTER (WHERE c_mktsegment = 'BUILDING') AS r FROM g)"""


@query("j1_equity_gap_table", GAP + """
SELECT c_mktsegment, n, round(m, 4) AS mean, round(s, 4) AS std, round(m - r, 4) AS gap_from_reference,
       round(m / r, 4) AS equity_index, round(r, 4) AS reference_mean FROM g, r""")
def _(t):
    return rounded(equity.equity_gap(t("customer"), "c_acctbal", ["c_mktsegment"], "BUILDING").tables["gap_table"], 4)


@query("j1_equity_gap", GAP + """
SELECT c_custkey, c_mktsegment, round(m, 4) AS group_mean, round(m / r, 6) AS equity_index FROM customer JOIN g USING (c_mktsegment), r""")
def _(t):
    rows = equity.equity_gap(t("customer"), "c_acctbal", ["c_mktsegment"], "BUILDING").rows
    return rounded(rows.select("c_custkey", "c_mktsegment", "group_mean", "equity_index"), 6, group_mean=4)


@query("j2_equity_metrics", """
WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
SELECT count(*) FILTER (WHERE n >= 12) AS n_groups_analyzed, count(*) FILTER (WHERE n < 12) AS n_groups_excluded_small,
  (SELECT round(avg(c_acctbal), 4) FROM customer) AS overall_mean, (SELECT round(avg(c_acctbal), 4) FROM customer) AS reference_mean FROM g""")
def _(t):
    return equity.equity_gap(t("customer"), "c_acctbal", ["c_mktsegment", "c_nationkey"], min_group_size=12).metrics


@query("j3_dfwi_summary", """
SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_dfwi,
       round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS dfwi_rate FROM lineitem GROUP BY 1""")
def _(t):
    return equity.dfwi(t("lineitem"), "l_returnflag", ["R"], ["l_linestatus"]).tables["dfwi_summary"]


@query("j3_dfwi_rows", "SELECT l_orderkey, l_linenumber, l_returnflag, l_returnflag = 'R' AS is_dfwi FROM lineitem")
def _(t):
    return equity.dfwi(t("lineitem"), "l_returnflag", ["R"]).rows.select("l_orderkey", "l_linenumber", "l_returnflag", "is_dfwi")


@query("j3_dfwi_subsets", """
SELECT l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_dfwi,
       round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS dfwi_rate
FROM lineitem GROUP BY CUBE (l_linestatus, l_linenumber)""")
def _(t):
    result = equity.dfwi(t("lineitem"), "l_returnflag", ["R"], ["l_linestatus", "l_linenumber"], all_subsets=True)
    return result.tables["dfwi_summary"]


@query("j4_peer_benchmark", """
WITH z AS (SELECT s_suppkey, s_acctbal, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS z,
  (rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0) / count(*) OVER () AS p FROM supplier)
SELECT s_suppkey, round(z, 4) AS s_acctbal_zscore, round(round(p, 4) * 100, 4) AS s_acctbal_percentile, s_suppkey = 5 AS is_focal FROM z""")
def _(t):
    rows = equity.peer_benchmark(t("supplier"), ["s_acctbal"], "s_suppkey", "5").rows
    return rounded(rows.drop("s_name", "s_nationkey", "s_acctbal"), 4)


@query("j4_focal_summary", """
WITH z AS (SELECT c_custkey, c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z,
  (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () AS p FROM customer)
SELECT 'c_acctbal' AS metric, c_acctbal AS value, round(z, 4) AS zscore, round(round(p, 4) * 100, 4) AS percentile FROM z WHERE c_custkey = 42""")
def _(t):
    return rounded(equity.peer_benchmark(t("customer"), ["c_acctbal"], "c_custkey", "42").tables["focal_institution_summary"], 4)


@query("j5_find_peers", """
WITH c AS (SELECT c_custkey AS unit_id, c_mktsegment AS carnegie_class, 'N' || (c_nationkey % 3) AS control_type,
  c_acctbal AS total_enrollment, CAST(c_custkey % 20 AS DOUBLE) AS pell_pct FROM customer),
a AS (SELECT * FROM c WHERE unit_id = 1)
SELECT c.unit_id, round(0.4 + 0.4 * (1 - least(abs(c.total_enrollment - a.total_enrollment) / greatest(a.total_enrollment, 1), 1))
   + 0.2 * (1 - least(abs(c.pell_pct - a.pell_pct) / 100, 1)), 6) AS score
FROM c JOIN a ON c.unit_id <> a.unit_id AND c.carnegie_class = a.carnegie_class AND c.control_type = a.control_type
 AND c.total_enrollment BETWEEN a.total_enrollment * 0.8 AND a.total_enrollment * 1.2 AND c.pell_pct BETWEEN a.pell_pct - 10 AND a.pell_pct + 10""")
def _(t):
    units = t("customer").select(
        F.col("c_custkey").alias("unit_id"),
        F.col("c_mktsegment").alias("carnegie_class"),
        F.concat(F.lit("N"), F.col("c_nationkey") % 3).alias("control_type"),
        F.col("c_acctbal").alias("total_enrollment"),
        (F.col("c_custkey") % 20).cast("double").alias("pell_pct"),
    )
    return rounded(equity.find_peers(units, 1).rows.select("unit_id", "score"))


@query("j6_intersectionality", """
WITH g AS (SELECT o_orderstatus || '|' || o_orderpriority AS group_key, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
r AS (SELECT max(m) AS r FROM g WHERE group_key = 'F|1-URGENT')
SELECT group_key, n, CAST(n AS VARCHAR) AS n_display, round(m, 4) AS group_mean, round(m / r, 4) AS di_ratio, round(m / r, 4) < 0.8 AS adverse_impact_flag FROM g, r""")
def _(t):
    rows = equity.intersectionality(t("orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"], ["F", "1-URGENT"]).rows
    return rounded(rows, 4)


@query("j6_suppression", """
WITH g AS (SELECT p_brand || '|' || p_type AS group_key, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), r AS (SELECT avg(p_retailprice) AS r FROM part)
SELECT group_key, CASE WHEN n >= 10 THEN n END AS n, CASE WHEN n >= 10 THEN CAST(n AS VARCHAR) ELSE '<10' END AS n_display,
  CASE WHEN n >= 10 THEN round(m, 4) END AS group_mean, CASE WHEN n >= 10 THEN round(m / r, 4) END AS di_ratio,
  CASE WHEN n >= 10 THEN round(m / r, 4) < 0.8 END AS adverse_impact_flag FROM g, r""")
def _(t):
    return rounded(equity.intersectionality(t("part"), "p_retailprice", ["p_brand", "p_type"]).rows, 4)


AID = """
WITH y AS (SELECT o_custkey AS student_id, year(o_orderdate) AS aid_year, sum(o_totalprice) / 100 AS efc, sum(l_q) * 10 AS grants, sum(l_x) * 100 AS loans
  FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS l_q, sum(l_tax * l_quantity) AS l_x FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY ALL),
a AS (SELECT y.*, CASE WHEN n.student_id IS NOT NULL THEN 1 ELSE 0 END AS persisted, efc - grants AS net_price, efc - grants - loans AS unmet,
  CASE WHEN efc - grants < 5000 THEN '<$5k' WHEN efc - grants < 10000 THEN '$5-10k' WHEN efc - grants < 15000 THEN '$10-15k' ELSE '>$15k' END AS aid_band
  FROM y LEFT JOIN (SELECT student_id, aid_year - 1 AS aid_year FROM y) n USING (student_id, aid_year))"""


def _aid(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("x")
    )
    years = (
        t("orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("student_id"), F.year("o_orderdate").alias("aid_year"))
        .agg(
            (F.sum("o_totalprice") / 100).alias("efc"),
            (F.sum("q") * 10).alias("total_grants"),
            (F.sum("x") * 100).alias("total_loans"),
        )
    )
    following = years.select("student_id", (F.col("aid_year") - 1).alias("aid_year"), F.lit(1).alias("persistence_flag"))
    return equity.financial_aid(years.join(following, ["student_id", "aid_year"], "left").na.fill(0, ["persistence_flag"]))


@query("j10_aid_bands", AID + """
SELECT aid_band, count(*) AS count, round(avg(persisted), 4) AS persistence_rate, round(avg(net_price), 2) AS mean_net_price FROM a GROUP BY 1""")
def _(t):
    return _aid(t).tables["cohort_table"]


@query("j11_persistence_model")
def _(t):
    return _aid(t).tables["regression_summary"]


# At the maximum of the likelihood the gaps between outcome and probability, alone and times
# each regressor, add up to nothing; probabilities are rounded to four places.
@query("j11_score_equations", "SELECT unnest(['one', 'net_price', 'total_grants', 'total_loans']) AS regressor, true AS met FROM (SELECT count(*) FROM orders)")
def _(t):
    gap = F.col("persistence_flag") - F.col("predicted_persistence_prob")
    rows = _aid(t).rows.withColumn("one", F.lit(1.0))
    names = ["one", "net_price", "total_grants", "total_loans"]
    pulls = rows.agg(*[(F.avg(gap * F.col(c)) / F.avg(F.abs(F.col(c)))).alias(c) for c in names])
    return pulls.unpivot([], names, "regressor", "pull").select("regressor", (F.abs("pull") < 1e-4).alias("met"))


@query("j11_persistence_rows")
def _(t):
    return _aid(t).rows.select("student_id", "aid_year", "aid_band", "net_price", "predicted_persistence_prob", "unmet_need")


@query("j12_unmet_need", AID + """
SELECT CAST(aid_year AS VARCHAR) AS aid_year, round(avg(unmet), 2) AS mean_unmet_need, count(*) AS student_count FROM a GROUP BY 1""")
def _(t):
    return _aid(t).tables["unmet_need_trend"]


# --- retention and funnels --------------------------------------------------------------


def _enrolment(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))


RETENTION = """
WITH e AS (SELECT c_mktsegment AS cohort, {label} AS period, min({at}) AS sort_no, count(DISTINCT o_custkey) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
i AS (SELECT cohort, arg_min(n, {by}) AS initial FROM e GROUP BY 1)
SELECT cohort, period, n AS enrolled_count, round(least(n / initial, 1), 6) AS retention_rate, round(1 - least(n / initial, 1), 6) AS attrition_rate
FROM e JOIN i USING (cohort)"""
SEMESTER = "year(o_orderdate) || CASE WHEN month(o_orderdate) < 8 THEN '-Spring' ELSE '-Fall' END"
HALF = "year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) < 8 THEN 0 ELSE 1 END"


@query("i5_retention", RETENTION.format(label=SEMESTER, at=HALF, by="period"))
def _(t):
    return rounded(cohort.retention(_enrolment(t), "o_custkey", "c_mktsegment", "o_orderdate").rows)


@query("i5_retention_chronological", RETENTION.format(label=SEMESTER, at=HALF, by="sort_no"))
def _(t):
    return rounded(cohort.retention(_enrolment(t), "o_custkey", "c_mktsegment", "o_orderdate", period_order="chronological").rows)


@query("i5_retention_annual", RETENTION.format(label="CAST(year(o_orderdate) AS VARCHAR)", at="year(o_orderdate)", by="period"))
def _(t):
    return rounded(cohort.retention(_enrolment(t), "o_custkey", "c_mktsegment", "o_orderdate", "annual").rows)


@query("i6_retention_metrics", f"""
SELECT count(DISTINCT c_mktsegment) AS cohort_count, count(DISTINCT {SEMESTER}) AS period_count, count(DISTINCT o_custkey) AS total_students
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    return cohort.retention(_enrolment(t), "o_custkey", "c_mktsegment", "o_orderdate").metrics


STAGES = ["view", "signup", "click", "purchase"]
# One individual is a user on one day, so that funnels end at different stages.
FLOW = """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, list_position(['view', 'signup', 'click', 'purchase'], event_type) AS r FROM events),
f AS (SELECT user_id, day, max(r) AS r FROM s WHERE r IS NOT NULL GROUP BY ALL)"""


def _flow(t, **kw):
    df = t("events").withColumns({"day": F.to_date("ts")})
    return cohort.cohort_flow(df, "user_id", "event_type", STAGES, cohort_column="day", **kw)


@query("i7_stage_reached", FLOW + """
SELECT event_id, e.user_id, ['view', 'signup', 'click', 'purchase'][r] AS stage_reached
FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.day = CAST(e.ts AS DATE)""")
def _(t):
    return _flow(t).rows.select("event_id", "user_id", "stage_reached")


@query("i8_funnel", FLOW + """, c AS (SELECT i, s, count(*) FILTER (WHERE r > i) AS n, count(*) FILTER (WHERE r >= i) AS p, count(*) AS a
  FROM f, (VALUES (0, 'view'), (1, 'signup'), (2, 'click'), (3, 'purchase')) v(i, s) GROUP BY ALL)
SELECT s AS stage, i AS stage_order, n AS n_reached, CASE WHEN i = 0 THEN 1.0 ELSE round(n / p, 4) END::DOUBLE AS conversion_from_previous,
       round(n / a, 4) AS pct_of_start FROM c""")
def _(t):
    return _flow(t).tables["funnel"]


@query("i8_funnel_by_day", FLOW + """, c AS (SELECT day, i, s, count(*) FILTER (WHERE r > i) AS n, count(*) FILTER (WHERE r >= i) AS p, count(*) AS a
  FROM f, (VALUES (0, 'view'), (1, 'signup'), (2, 'click'), (3, 'purchase')) v(i, s) GROUP BY ALL)
SELECT day, s AS stage, i AS stage_order, n AS n_reached, CASE WHEN i = 0 THEN 1.0 ELSE round(n / p, 4) END::DOUBLE AS conversion_from_previous,
       round(n / a, 4) AS pct_of_start FROM c""")
def _(t):
    return _flow(t, group_by=["day"]).tables["funnel"]

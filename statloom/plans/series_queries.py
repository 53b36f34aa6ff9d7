"""Queries for forecasts, change points, decomposition and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import timeseries as ts
from statloom.plans.registry import query, rounded


def _monthly(t):
    """Orders and revenue per month and priority."""
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return (
        t("orders")
        .groupBy(month.alias("month"), F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("revenue"))
        .withColumn("row_id", F.year("month") * 12 + F.month("month"))
    )


def _daily(t):
    """Mean value per day and event type, raised from the middle of the month on."""
    day = F.to_date("ts")
    raised = F.when(F.col("day") >= F.lit("2024-01-16").cast("date"), 100.0).otherwise(0.0)
    return (
        t("events")
        .groupBy(day.alias("day"), "event_type")
        .agg(F.avg("value").alias("mean_value"))
        .withColumn("mean_value", F.col("mean_value") + raised)
        .withColumn("row_id", F.dayofyear("day"))
    )


@query("h1_forecast")
def _(t):
    return ts.forecast(_monthly(t), "month", "revenue", "priority", 12).rows


@query("h1_forecast_horizon", """
WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::TIMESTAMP AS ds FROM orders GROUP BY ALL),
l AS (SELECT series, max(ds) AS last FROM m GROUP BY 1)
SELECT series, ds, false AS is_forecast FROM m
UNION ALL SELECT series, (last + to_months(CAST(i AS INTEGER)))::TIMESTAMP, true FROM l, (SELECT unnest(range(1, 13)) AS i)""")
def _(t):
    return ts.forecast(_monthly(t), "month", "orders", "priority", 12, "multiplicative").rows.select("series", "ds", "is_forecast")


# What the interval of a future date has beyond that of a known one, squared, is as the cube
# of the time ahead: here against that of the twelfth month.
@query("h1_intervals_widen", """
WITH l AS (SELECT o_orderpriority AS series, max(date_trunc('month', o_orderdate))::DATE AS last FROM orders GROUP BY 1)
SELECT series, CAST(i AS INTEGER) AS i,
  round((date_diff('day', last, (last + to_months(CAST(i AS INTEGER)))::DATE) / date_diff('day', last, (last + INTERVAL 12 MONTH)::DATE)::DOUBLE) ** 3, 5) AS share
FROM l, (SELECT unnest(range(1, 13)) AS i)""")
def _(t):
    rows = ts.forecast(_monthly(t), "month", "revenue", "priority", 12).rows.withColumn("wide", F.pow(F.col("yhat_upper") - F.col("yhat_lower"), 2))
    known = rows.groupBy("series").agg(
        F.max(F.when(~F.col("is_forecast"), F.col("wide"))).alias("base"), F.max("wide").alias("most"), F.max(F.when(~F.col("is_forecast"), F.col("ds"))).alias("last")
    )
    ahead = F.months_between(F.trunc("ds", "month"), F.trunc("last", "month")).cast("int")
    share = F.round((F.col("wide") - F.col("base")) / (F.col("most") - F.col("base")), 5)
    return rows.filter("is_forecast").join(known, "series").select("series", ahead.alias("i"), share.alias("share"))


@query("h1_forecast_range", """
WITH m AS (SELECT o_orderpriority AS series, count(DISTINCT date_trunc('month', o_orderdate)) AS training_rows, max(date_trunc('month', o_orderdate))::TIMESTAMP AS training_end FROM orders GROUP BY 1)
SELECT series, training_rows, training_end, 'MS' AS frequency, (training_end + INTERVAL 1 MONTH)::TIMESTAMP AS forecast_start, (training_end + INTERVAL 12 MONTH)::TIMESTAMP AS forecast_end FROM m""")
def _(t):
    return ts.forecast(_monthly(t), "month", "revenue", "priority", 12).tables["series"]


FREQ = """CASE WHEN m IS NULL THEN 'MS' WHEN m <= 1.5 THEN 'D' WHEN m <= 8 THEN 'W' WHEN m <= 35 THEN 'MS' WHEN m <= 100 THEN 'QS' ELSE 'YS' END"""


@query("h2_infer_frequency", f"""
WITH d AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS series, o_orderdate AS ds FROM orders),
g AS (SELECT series, date_diff('day', lag(ds) OVER (PARTITION BY series ORDER BY ds), ds)::DOUBLE AS g FROM d),
f AS (SELECT series, median(g) AS m FROM g GROUP BY 1)
SELECT series, m AS median_days, {FREQ} AS frequency FROM f""")
def _(t):
    return ts.infer_frequency(t("orders"), "o_orderdate", "o_custkey")


@query("h3_future_dates", """
WITH m AS (SELECT o_orderpriority AS series, max(date_trunc('month', o_orderdate))::TIMESTAMP AS last FROM orders GROUP BY 1)
SELECT series, CAST(i AS INTEGER) AS i, (last + to_months(CAST(i AS INTEGER)))::TIMESTAMP AS ds FROM m, (SELECT unnest(range(1, 7)) AS i)""")
def _(t):
    return ts.future_dates(_monthly(t), "month", 6, "priority")


# Every way to cut the days of a type at multiples of five, as a set of bits, with its cost:
# the best one holds the breaks. The table has 30 days.
DAYS = """
WITH a AS (SELECT event_type, ts::DATE AS day, avg(value) AS mean FROM events GROUP BY ALL),
y AS (SELECT event_type, day, CASE WHEN day >= DATE '2024-01-16' THEN mean + 100 ELSE mean END AS y FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM y),
s AS (SELECT d.*, mask, bit_count(mask & ((1::BIGINT << (pos // 5)::INTEGER) - 1)) AS seg FROM d, (SELECT unnest(range(32)) AS mask)),
z AS (SELECT event_type, mask, seg, count(*) AS len, var_pop(y) * count(*) AS spread FROM s GROUP BY ALL),
ok AS (SELECT event_type, mask, count(*) AS segs, sum(spread) AS spread FROM z GROUP BY event_type, mask HAVING min(len) >= 3 AND count(*) = bit_count(mask) + 1)"""
BROKEN = """
SELECT event_type, day, {values}pos > 0 AND pos % 5 = 0 AND (mask >> greatest(pos // 5 - 1, 0)::INTEGER) & 1 = 1 AS change_point,
  CAST(CASE WHEN pos = 0 THEN 0 ELSE bit_count(mask & ((1::BIGINT << ((pos - 1) // 5)::INTEGER) - 1)) END AS INTEGER) AS segment_id
FROM d JOIN best USING (event_type)"""


@query("h4_change_points", DAYS + """,
p AS (SELECT event_type, greatest(ln(count(*)) * var_pop(y), 1e-6) AS pen FROM d GROUP BY 1),
best AS (SELECT event_type, arg_min(mask, spread + segs * pen) AS mask FROM ok JOIN p USING (event_type) GROUP BY 1)"""
+ BROKEN.format(values=""))
def _(t):
    result = ts.change_points(_daily(t), "day", "mean_value", "row_id", "event_type", model="l2")
    return result.rows.select("event_type", "day", "change_point", "segment_id")


@query("h4_change_points_kernel", DAYS + """,
q AS (SELECT a.event_type, a.pos AS i, b.pos AS j, (a.y - b.y) ** 2 AS apart FROM d a JOIN d b USING (event_type)),
g AS (SELECT event_type, median(apart) FILTER (WHERE i < j) AS m FROM q GROUP BY 1),
k AS (SELECT event_type, i, j, CASE WHEN i = j THEN 1 ELSE exp(-least(greatest(apart / CASE WHEN m > 0 THEN m ELSE 1 END, 0.01), 100)) END AS near
  FROM q JOIN g USING (event_type)),
c AS (SELECT a.event_type, a.mask, sum(near / z.len) AS kept FROM s a JOIN s b ON a.event_type = b.event_type AND a.mask = b.mask AND a.seg = b.seg
  JOIN k ON k.event_type = a.event_type AND k.i = a.pos AND k.j = b.pos JOIN z ON z.event_type = a.event_type AND z.mask = a.mask AND z.seg = a.seg GROUP BY ALL),
best AS (SELECT event_type, arg_min(mask, segs - kept) AS mask FROM ok JOIN c USING (event_type, mask) GROUP BY 1)"""
+ BROKEN.format(values="round(y, 6) AS mean_value, dayofyear(day)::INTEGER AS row_id, "))
def _(t):
    return rounded(ts.change_points(_daily(t), "day", "mean_value", "row_id", "event_type", model="rbf", penalty=1.0).rows)


@query("h5_segment_ids", """
SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_id FROM events""")
def _(t):
    events = t("events").withColumn("broke", F.col("event_type") == "error")
    return ts.segment_ids(events, "broke", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "segment_id")


# The planted shift of 100 dwarfs the noise: the break sits at day 16, position 15.
@query("h6_change_point_table", """
SELECT event_type AS "group", CAST(15 AS BIGINT) AS position, '2024-01-16 00:00:00' AS date FROM events GROUP BY 1""")
def _(t):
    return ts.change_points(_daily(t), "day", "mean_value", "row_id", "event_type", model="l2").tables["change_points"]


@query("h7_decompose")
def _(t):
    return ts.decompose(_monthly(t), "month", "revenue", "row_id", "priority", 12).rows


@query("h7_parts_add_up", """
SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def _(t):
    rows = ts.decompose(_monthly(t), "month", "revenue", "row_id", "priority", 12).rows
    return rows.select("month", "priority", F.round(F.col("trend") + F.col("seasonal") + F.col("residual"), 2).alias("total"))


@query("h8_multiplicative", """
WITH v AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
  (sum(y) OVER (PARTITION BY g ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 AS tr
  FROM v WINDOW w AS (PARTITION BY g ORDER BY month)),
t AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN tr END AS trend, pos % 12 AS ph FROM n),
s AS (SELECT g, ph, avg(y / trend) AS r FROM t GROUP BY ALL),
z AS (SELECT g, ph, r / avg(r) OVER (PARTITION BY g) AS seasonal FROM s)
SELECT g AS priority, month, round(trend, 0) AS trend, round(seasonal, 6) AS seasonal, round(y / (trend * seasonal), 6) AS residual FROM t JOIN z USING (g, ph)""")
def _(t):
    rows = ts.decompose(_monthly(t), "month", "revenue", "row_id", "priority", 12, "multiplicative").rows
    return rounded(rows.select("priority", "month", "trend", "seasonal", "residual"), 6, trend=0)


@query("h9_infer_period", """
WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS series, o_orderdate AS ds FROM orders),
g AS (SELECT series, date_diff('second', lag(ds) OVER (PARTITION BY series ORDER BY ds), ds) / 86400.0::DOUBLE AS g FROM d),
f AS (SELECT series, median(g) AS m FROM g GROUP BY 1)
SELECT series, m AS median_days, CASE WHEN m IS NULL THEN 12 WHEN m <= 1.5 THEN 7 WHEN m <= 8 THEN 52 WHEN m <= 35 THEN 12 WHEN m <= 100 THEN 4 ELSE 2 END AS period FROM f""")
def _(t):
    return ts.infer_period(t("orders"), "o_orderdate", "o_custkey")


def _holes(t):
    return t("events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query("h10_fill_forward", """
WITH e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)
SELECT event_id, event_type, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled_value FROM e""")
def _(t):
    rows = ts.fill_gaps(_holes(t), "ts", "value", "event_id", "event_type").rows
    return rounded(rows.select("event_id", "event_type", "filled_value"))


@query("h10_fill_linear", """
WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv FROM e
  WINDOW b AS (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, event_type, round(coalesce(v, pv + (nv - pv) * (i - pi) / (ni - pi), pv, nv), 6) AS filled_value FROM w""")
def _(t):
    rows = ts.fill_gaps(_holes(t), "ts", "value", "event_id", "event_type", "linear").rows
    return rounded(rows.select("event_id", "event_type", "filled_value"))

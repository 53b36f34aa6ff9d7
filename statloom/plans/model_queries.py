"""Queries for forests, clustering, anomalies, item response models, user functions, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from statloom.operators import anomaly, assessment, cluster, custom, forest
from statloom.plans.registry import query, rounded
from statloom.session import cut_lineage
from statloom.plans.relational_queries import COST, jobs
from statloom.plans.source_queries import scratch
from statloom.streaming import jobs as streams


@query("f9_forest_classify")
def _(t):
    result = forest.random_forest(t("part"), "p_type", ["p_size", "p_retailprice"], id_columns=["p_partkey"])
    return result.rows.drop("p_name")


@query("f9_forest_report")
def _(t):
    part = t("part").withColumn("big", (F.col("p_size") > 25).cast("int"))
    result = forest.random_forest(part, "big", ["p_size", "p_retailprice"], task="classify", id_columns=["p_partkey"])
    return result.tables["classification_report"]


# A forest on a target that is a threshold of a feature finds the threshold.
@query("f9_forest_learns_rule", "SELECT p_partkey, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS predicted_class FROM part")
def _(t):
    part = t("part").withColumn("big", (F.col("p_size") > 25).cast("int"))
    result = forest.random_forest(part, "big", ["p_size"], task="classify", id_columns=["p_partkey"])
    return result.rows.select("p_partkey", "predicted_class")


@query("f10_forest_regress")
def _(t):
    result = forest.random_forest(t("part"), "p_retailprice", ["p_size", "p_partkey"], id_columns=["p_partkey"])
    return result.rows.select("p_partkey", "predicted_value")


@query("f12_importances")
def _(t):
    result = forest.random_forest(t("part"), "p_retailprice", ["p_size", "p_partkey"], id_columns=["p_partkey"])
    return result.tables["feature_importances"]


# A target that is a step of one feature: every tree cuts there, whatever rows it drew.
def _step(t):
    part = t("part").select("p_partkey", (F.col("p_size") % 16).alias("slot"), F.lit(1.0).alias("same"))
    target = F.when(F.col("slot") >= 8, 10.0).otherwise(2.5)
    return forest.random_forest(part.withColumn("level", target), "level", ["slot", "same"], id_columns=["p_partkey"], n_estimators=30)


@query("f10_forest_finds_step", "SELECT p_partkey, CASE WHEN p_size % 16 >= 8 THEN 10.0 ELSE 2.5 END::DOUBLE AS predicted_value FROM part")
def _(t):
    return rounded(_step(t).rows.select("p_partkey", "predicted_value"), 6)


@query("f12_importance_of_step", """
SELECT 'slot' AS feature, CASE WHEN count(DISTINCT p_size % 16 >= 8) = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM part UNION ALL SELECT 'same', 0.0""")
def _(t):
    return _step(t).tables["feature_importances"]


def _customers(t):
    totals = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count("*").alias("orders"))
    return t("customer").join(totals, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_acctbal", "spend", "orders")


@query("g1_kmeans")
def _(t):
    return cluster.kmeans(_customers(t), ["c_acctbal", "spend", "orders"], k=4).rows


@query("g2_kmeans_sizes")
def _(t):
    return cluster.kmeans(_customers(t), ["c_acctbal", "spend", "orders"], k=4).tables["cluster_sizes"]


CENTERS = [[-1.0, -1.0], [1.0, 1.0], [0.0, 0.5]]
ASSIGN = """
WITH c AS (SELECT c_custkey, c_acctbal, sum(o_totalprice) AS spend FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (spend - avg(spend) OVER ()) / stddev_pop(spend) OVER () AS y FROM c),
d AS (SELECT c_custkey, (x + 1) ** 2 + (y + 1) ** 2 AS d0, (x - 1) ** 2 + (y - 1) ** 2 AS d1, x ** 2 + (y - 0.5) ** 2 AS d2 FROM s),
a AS (SELECT c_custkey, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster_id, sqrt(least(d0, d1, d2)) AS cluster_distance FROM d)"""


@query("g1_kmeans_assign", ASSIGN + " SELECT c_custkey, cluster_id, round(cluster_distance, 6) AS cluster_distance FROM a")
def _(t):
    rows = cluster.kmeans_assign(_customers(t), ["c_acctbal", "spend"], CENTERS).rows
    return rounded(rows.select("c_custkey", "cluster_id", "cluster_distance"))


@query("g2_assigned_sizes", ASSIGN + " SELECT cluster_id, count(*) AS n FROM a GROUP BY 1")
def _(t):
    return cluster.kmeans_assign(_customers(t), ["c_acctbal", "spend"], CENTERS).tables["cluster_sizes"]


@query("g1_kmeans_embeddings")
def _(t):
    size = t("embeddings").agg(F.max(F.size("embedding"))).head()[0]
    names = [f"e{i}" for i in range(size)]
    vectors = t("embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return cluster.kmeans(vectors, names, k=5).rows.select("vec_id", "cluster_id", "cluster_distance")


def _planted(t):
    """Orders with every 500th price raised a hundredfold."""
    raised = F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice"))
    return t("orders").select("o_orderkey", "o_orderpriority", raised.alias("price"), (F.col("o_custkey") % 100).alias("customer_class"))


@query("g3_isolation_forest")
def _(t):
    return anomaly.isolation_forest(_planted(t), ["price", "customer_class"], 0.05).rows


@query("g3_planted_outliers_found", "SELECT o_orderkey, true AS is_anomaly FROM orders WHERE o_orderkey % 500 = 0 AND o_totalprice > 50000")
def _(t):
    rows = anomaly.isolation_forest(_planted(t), ["price"], 0.01).rows
    return rows.filter("o_orderkey % 500 = 0 and price > 5000000").select("o_orderkey", "is_anomaly")


@query("g4_anomaly_metrics", """
SELECT count(*) AS rows_used, CAST(0 AS BIGINT) AS rows_excluded, true AS rate_near_contamination FROM orders""")
def _(t):
    m = anomaly.isolation_forest(_planted(t), ["price", "customer_class"], 0.05).metrics
    return m.select("rows_used", "rows_excluded", (F.abs(F.col("anomaly_rate") - 0.05) < 0.002).alias("rate_near_contamination"))


def _literature(t):
    """What is known per priority: text and sources derived from the orders."""
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", "Calibration drift of the scale")
        .when(p == "2-HIGH", "Sensor NOISE at high load")
        .otherwise("Reported before")
    )
    sources = F.when(p == "4-NOT SPECIFIED", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(p, F.lit("/"), i.cast("string")))
    )
    return t("orders").select("o_orderpriority").filter(p != "5-LOW").distinct().select("o_orderpriority", text.alias("content"), sources.alias("sources"))


@query("g5_anomaly_hypothesis")
def _(t):
    result = anomaly.anomaly_hypothesis(_planted(t), ["price"], "behavioral", literature=_literature(t), literature_keys=["o_orderpriority"])
    return result.rows


@query("g5_planted_anomalies_explained", """
SELECT o_orderkey, true AS is_anomaly,
 CASE o_orderpriority WHEN '5-LOW' THEN 'novel_candidate' WHEN '1-URGENT' THEN 'instrument_error' WHEN '2-HIGH' THEN 'known_noise' WHEN '4-NOT SPECIFIED' THEN 'novel_candidate' ELSE 'reported_effect' END AS anomaly_class,
 CASE o_orderpriority WHEN '5-LOW' THEN 0.5 WHEN '1-URGENT' THEN 0.8 WHEN '2-HIGH' THEN 0.7 WHEN '4-NOT SPECIFIED' THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence
FROM orders WHERE o_orderkey % 500 = 0 AND o_totalprice > 50000""")
def _(t):
    result = anomaly.anomaly_hypothesis(_planted(t), ["price"], "behavioral", literature=_literature(t), literature_keys=["o_orderpriority"])
    planted = result.rows.filter("o_orderkey % 500 = 0 and price > 5000000")
    return planted.select("o_orderkey", "is_anomaly", "anomaly_class", "confidence")


@query("g6_classify_anomalies", """
WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_totalprice > 400000 AS f FROM orders)
SELECT o_orderkey, f AS is_anomaly,
 CASE WHEN NOT f THEN '' WHEN p = '5-LOW' THEN 'novel_candidate' WHEN p = '1-URGENT' THEN 'instrument_error' WHEN p = '2-HIGH' THEN 'known_noise' WHEN p = '4-NOT SPECIFIED' THEN 'novel_candidate' ELSE 'reported_effect' END AS anomaly_class,
 CASE WHEN NOT f THEN NULL WHEN p = '5-LOW' THEN 0.5 WHEN p = '1-URGENT' THEN 0.8 WHEN p = '2-HIGH' THEN 0.7 WHEN p = '4-NOT SPECIFIED' THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence,
 CASE WHEN NOT f OR p IN ('5-LOW', '4-NOT SPECIFIED') THEN '' ELSE p || '/1; ' || p || '/2; ' || p || '/3; ' || p || '/4; ' || p || '/5; ' || p || '/6; ' || p || '/7' END AS supporting_citations FROM o""")
def _(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = anomaly.classify_anomalies(orders, F.col("o_totalprice") > 400000, _literature(t), ["o_orderpriority"])
    return rows.drop("o_orderpriority", "o_totalprice")


# --- item response ----------------------------------------------------------------------

ITEMS = ["click", "error", "purchase", "signup", "view"]
PARAMETERS = {"click": (1.0, -0.5), "error": (1.2, 0.0), "purchase": (0.8, 0.4), "signup": (1.5, 0.1), "view": (0.9, -0.2)}


def _responses(t):
    """Which event types a user showed on a day, as five yes/no items."""
    seen = [F.max((F.col("event_type") == i).cast("int")).alias(i) for i in ITEMS]
    person = F.concat(F.col("user_id"), F.lit("@"), F.to_date("ts").cast("string"))
    return t("events").groupBy(person.alias("person")).agg(*seen)


@query("j7_item_parameters")
def _(t):
    return assessment.irt_2pl(_responses(t), ITEMS, "person").tables["item_parameters"]


def _drawn_responses(t):
    """Answers of orders whose ability and luck are hashes of their keys."""
    share = lambda *salt: F.pmod(F.xxhash64("o_orderkey", *map(F.lit, salt)), F.lit(100_003)) / 100_003
    ability = sum((share("ability", i) for i in range(12)), F.lit(-6.0))  # twelve uniforms: mean 0, deviation 1
    right = {i: 1 / (1 + F.exp(-a * (F.col("ability") - b))) for i, (a, b) in PARAMETERS.items()}
    answers = [(share("luck", i) < p).cast("int").alias(i) for i, p in right.items()]
    return t("orders").withColumn("ability", ability).select(F.col("o_orderkey").alias("person"), *answers)


# At the maximum of the likelihood the answers expected of all persons, and their products
# with ability, are the observed ones: both gaps are 0 per person, for every item.
@query("j7_likelihood_equations", f"SELECT unnest({ITEMS}) AS item, true AS level_met, true AS slope_met FROM (SELECT count(*) FROM orders)")
def _(t):
    answers = _drawn_responses(t)
    fitted = assessment.irt_2pl(answers, ITEMS, "person", max_rounds=400).tables["item_parameters"].collect()  # one row per item
    x = F.col("x")
    right = {r["item"]: 1 / (1 + F.exp(-r["discrimination"] * (x - r["difficulty"]))) for r in fitted}
    said = {i: F.log(F.when(F.col(i) == 1, right[i]).otherwise(1 - right[i])) for i in ITEMS}
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda g: -4 + 0.2 * g))
    # written first: the join below would ask every order for answers that are not null
    patterns = cut_lineage(answers.groupBy(*ITEMS).agg(F.count("*").alias("n"))).withColumn("x", grid)
    weighed = patterns.withColumn("w", F.exp(sum(said.values(), -x * x / 2)))
    shares = weighed.groupBy(*ITEMS).agg(F.sum("w").alias("all_w")).join(weighed, ITEMS).withColumn("w", F.col("n") * F.col("w") / F.col("all_w"))
    gaps = F.array(*[F.struct(F.lit(i).alias("item"), ((F.col(i) - right[i]) * F.col("w")).alias("gap")) for i in ITEMS])
    spread = shares.select("x", "w", F.explode(gaps).alias("g"))
    met = lambda v: F.abs(F.sum(v) / F.sum("w")) < 1e-3
    return spread.groupBy("g.item").agg(met(F.col("g.gap")).alias("level_met"), met(F.col("g.gap") * x).alias("slope_met"))


def _log_sum() -> str:
    parts = []
    for c, (a, b) in PARAMETERS.items():
        p = f"(1 / (1 + exp(-{a} * (x - ({b})))))"
        parts.append(f"CASE WHEN {c} = 1 THEN ln({p}) ELSE ln(1 - {p}) END")
    return " + ".join(parts)


@query("j8_abilities", f"""
WITH r AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS person, {", ".join(f"max(CAST(event_type = '{i}' AS INTEGER)) AS {i}" for i in ITEMS)} FROM events GROUP BY 1),
g AS (SELECT -4 + 0.2::DOUBLE * unnest(range(41)) AS x),
w AS (SELECT person, x, exp({_log_sum()} - x * x / 2) AS w FROM r, g),
m AS (SELECT person, sum(w * x) / sum(w) AS theta, sum(w * x * x) / sum(w) AS q FROM w GROUP BY 1)
SELECT person AS person_id, round(theta, 6) + 0.0 AS theta, round(sqrt(q - theta * theta), 6) AS se FROM m""")
def _(t):
    return rounded(assessment.eap_abilities(_responses(t), PARAMETERS, "person"))


@query("j9_item_information", """
WITH i AS (SELECT event_type AS item, 0.5 + length(event_type) / 10.0::DOUBLE AS a, avg(value) / 100 AS b FROM events GROUP BY 1)
SELECT item, x AS theta, round(a * a * (1 / (1 + exp(-a * (x - b)))) * (1 - 1 / (1 + exp(-a * (x - b)))), 8) AS information
FROM i, (SELECT unnest([-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]::DOUBLE[]) AS x)""")
def _(t):
    items = t("events").groupBy(F.col("event_type").alias("item")).agg(
        (F.avg("value") / 100).alias("difficulty"), (0.5 + F.length(F.first("event_type")) / 10.0).alias("discrimination")
    )
    return rounded(assessment.item_information(items), 8)


# --- user functions ---------------------------------------------------------------------


@query("o1_custom_transform", "SELECT event_id, round(value * 2, 6) AS doubled FROM events WHERE value > 20")
def _(t):
    result = custom.custom_transform(
        t("events"), lambda df: df.filter("value > 20").select("event_id", (F.col("value") * 2).alias("doubled"))
    )
    return rounded(result.rows)


@query("o2_custom_batches", "SELECT event_id, upper(event_type) || '!' AS label FROM events")
def _(t):
    def shout(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["event_id"], "label": batch["event_type"].str.upper() + "!"})

    return custom.custom_batches(t("events").select("event_id", "event_type"), shout, "event_id long, label string").rows


@query("o3_custom_grouped", "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def _(t):
    def spread(group: pd.DataFrame) -> pd.DataFrame:
        values = group["value"]
        return pd.DataFrame({"user_id": [group["user_id"].iloc[0]], "spread": [values.max() - values.min()]})

    return rounded(custom.custom_grouped(t("events").select("user_id", "value"), ["user_id"], spread, "user_id long, spread double").rows)


# --- streams ----------------------------------------------------------------------------


def _stream(t, close: bool = False):
    """The events as a stream of jobs, of four files that follow each other in time and one to close."""
    events, folder = t("events"), scratch(t, "events")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75], 1000).alias("q")).first()["q"]
    quarter = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: F.unix_micros(F.col("ts").cast("timestamp")) > q))
    for i in range(4):
        events.filter(quarter == i).coalesce(1).write.mode("append").parquet(folder)
    if close:
        streams.closing_record(events, "ts").write.mode("append").parquet(folder)
    raw = streams.job_stream(t.spark, folder, events.schema, per_batch=1)
    cost = F.when(F.col("event_type") != "error", F.col("value"))
    return raw.select(
        F.col("event_id").alias("job_id"),
        "user_id",
        F.col("event_type").alias("profile_id"),
        F.col("ts").alias("started_at"),
        cost.alias("cost"),
        F.lit(1.5).alias("estimated_cost"),
        (F.col("value") * 60).alias("duration_seconds"),
    )


@query("s1_run_incremental", f"""
SELECT user_id, strftime(ts, '%Y-%m') AS month, round(sum({COST}), 4) AS spend, count(*) AS jobs FROM events GROUP BY ALL""")
def _(t):
    from statloom.operators.ledger import monthly_spend

    folder = scratch(t, "incremental")
    streams.run_incremental(lambda df: monthly_spend(df).rows, _stream(t), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return rounded(streams.merged(t.spark, f"{folder}/out", ["user_id", "month"], ["spend", "jobs"]), 4)


@query("s2_stream_budget_alerts", f"""
SELECT user_id, month, job_id, round(after - c, 4) AS spend_before, round(after, 4) AS spend_after FROM (
  SELECT user_id, event_id AS job_id, strftime(ts, '%Y-%m') AS month, {COST} AS c,
    sum({COST}) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after
  FROM events) WHERE after >= 2640 AND after - c < 2640""")
def _(t):
    folder = scratch(t, "alerts")
    streams.write_closed(streams.stream_budget_alerts(_stream(t), 3300.0), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return rounded(t.spark.read.parquet(f"{folder}/out"), 4)


@query("s3_stream_spend", f"""
SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, user_id, spend, jobs FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS d, user_id, round(sum({COST}), 4) AS spend, count(*) AS jobs FROM events GROUP BY ALL)""")
def _(t):
    folder = scratch(t, "spend")
    streams.write_closed(streams.stream_spend(_zoned(t)), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return _plain_windows(rounded(t.spark.read.parquet(f"{folder}/out"), 4))


def _zoned(t):
    """Event time for watermarks has to be a timestamp with the session's zone."""
    return _stream(t, close=True).withColumn("started_at", F.col("started_at").cast("timestamp"))


def _plain_windows(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("s4_stream_job_metrics", f"""
SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, profile_id, cost, seconds, jobs FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS d, event_type AS profile_id, round(sum({COST}), 4) AS cost, round(sum(value * 60), 4) AS seconds, count(*) AS jobs
  FROM events GROUP BY ALL)""")
def _(t):
    folder = scratch(t, "metrics")
    streams.write_closed(streams.stream_job_metrics(_zoned(t)), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return _plain_windows(rounded(t.spark.read.parquet(f"{folder}/out"), 4))

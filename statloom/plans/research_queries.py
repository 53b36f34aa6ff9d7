"""Queries for grants, collaboration networks, lineage, power and reproducibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import grants, lineage, network, power
from statloom.plans.registry import query, rounded
from statloom.session import tasks_for


def _transactions(t):
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("award_id"),
            F.col("l_linenumber"),
            F.col("l_partkey"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            F.col("o_totalprice").alias("budget"),
            F.col("l_shipdate").alias("date"),
            F.col("o_custkey").alias("pi"),
            F.col("l_returnflag").alias("area"),
        )
    )


def _portfolio(t):
    return grants.grant_portfolio(_transactions(t), "amount", "budget", "date", "award_id", pi_column="pi")


AWARDS = """
WITH d AS (SELECT l_orderkey AS award_id, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS amount, o_totalprice AS budget, o_custkey AS pi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT award_id, sum(amount) AS spent, max(budget) AS budget, sum(amount) / max(budget) AS burn FROM d GROUP BY 1)"""


@query("l1_grant_portfolio", AWARDS + """
SELECT award_id, l_linenumber, l_partkey, round(burn, 6) AS burn_rate, round(burn * 100, 4) AS pct_expended, burn > 0.9 AS nce_risk FROM d JOIN a USING (award_id)""")
def _(t):
    rows = _portfolio(t).rows.drop("amount", "budget", "date", "pi", "area")
    return rounded(rows, 6, pct_expended=4)


@query("l1_award_summary", AWARDS + """
SELECT award_id, round(spent, 4) AS total_spent, round(budget, 4) AS total_budget, round(burn, 4) AS burn_rate, round(burn * 100, 4) AS pct_expended, burn > 0.9 AS nce_risk FROM a""")
def _(t):
    return _portfolio(t).tables["portfolio_summary"]


@query("l2_portfolio_totals", AWARDS + """
SELECT count(*) AS n_awards, count(*) FILTER (WHERE burn > 0.9) AS n_at_nce_risk, round(sum(spent), 2) AS total_portfolio_spend,
       round(sum(budget), 2) AS total_portfolio_budget, CAST(0 AS BIGINT) AS rows_excluded_missing_data FROM a""")
def _(t):
    return _portfolio(t).metrics


@query("l3_pi_summary", AWARDS + """
SELECT pi, count(DISTINCT award_id) AS n_awards, round(sum(amount), 1) AS total_spent,
       round(sum(CASE WHEN burn > 0.9 THEN 1 ELSE 0 END) / count(*), 4) AS pct_at_nce_risk FROM d JOIN a USING (award_id) GROUP BY 1""")
def _(t):
    return rounded(_portfolio(t).tables["pi_summary"], 4, total_spent=1)


@query("l4_award_clusters")
def _(t):
    result = grants.grant_portfolio(_transactions(t), "amount", "budget", "date", "award_id", research_area_column="area")
    return result.tables["area_clusters"]


# Awards that have spent a tenth, half or nine tenths: three clusters, named by their smallest award.
@query("l4_planted_clusters", """
SELECT o_orderkey AS award_id, min(o_orderkey) OVER (PARTITION BY o_orderkey % 3) AS cluster, o_orderpriority AS research_area FROM orders""")
def _(t):
    spent = F.col("o_totalprice") * F.element_at(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    awards = t("orders").withColumn("spent", spent)
    result = grants.grant_portfolio(awards, "spent", "o_totalprice", "o_orderdate", "o_orderkey", research_area_column="o_orderpriority")
    found = result.tables["area_clusters"]
    names = found.groupBy("award_cluster").agg(F.min("award_id").alias("cluster"))
    return found.join(names, "award_cluster").select("award_id", "cluster", "research_area")


def _grants(t):
    return t("orders").select(
        F.col("o_custkey").alias("pi"),
        F.to_date("o_orderdate").alias("start_date"),
        F.date_add(F.to_date("o_orderdate"), 400).alias("end_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("sponsor"),
        F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("submitted"),
    )


def _health(t):
    return grants.pi_health(_grants(t), "pi", "start_date", "end_date", "amount", "sponsor", "submitted", as_of="2000-01-01")


GRANTS = """
WITH g AS (SELECT o_custkey AS pi, o_orderdate::DATE AS s, o_orderdate::DATE + 400 AS e, o_totalprice AS amount, o_orderpriority AS sponsor,
  o_orderdate::DATE - CAST(o_orderkey % 90 AS INTEGER) AS sub, DATE '2000-01-01' AS d FROM orders)"""


@query("l5_pi_health", GRANTS + """,
c AS (SELECT pi, count(DISTINCT m) AS months FROM g, (SELECT unnest(range(12)) AS m) WHERE e >= d AND s <= d + CAST(30 * m AS INTEGER) AND d + CAST(30 * m AS INTEGER) <= e GROUP BY pi),
p AS (SELECT pi, count(*) FILTER (WHERE s <= d AND e >= d) AS active, count(*) FILTER (WHERE e >= d AND e <= d + 60) AS ending, count(DISTINCT sponsor) AS sponsors FROM g GROUP BY pi)
SELECT CAST(pi AS VARCHAR) AS pi, active AS active_grants, ending AS ending_soon, CAST(12 - coalesce(months, 0) AS INTEGER) AS funding_gap_months,
  round(ending / greatest(active, 1), 3) AS nce_risk_score,
  round(least(active / 3.0::DOUBLE, 1) * 0.4::DOUBLE + coalesce(months, 0) / 12.0::DOUBLE * 0.4::DOUBLE + least(sponsors / 5.0::DOUBLE, 1) * 0.2::DOUBLE, 3) AS health_score
FROM p LEFT JOIN c USING (pi)""")
def _(t):
    return _health(t).rows


@query("l6_grant_summary", GRANTS + """
SELECT count(*) FILTER (WHERE s <= d AND e >= d) AS total_active_grants, round(sum(amount) FILTER (WHERE e >= d), 2) AS total_active_amount,
       count(DISTINCT pi) AS pi_count FROM g""")
def _(t):
    return rounded(_health(t).tables["portfolio_summary"], 2)


@query("l7_sponsor_timing", GRANTS + " SELECT sponsor, round(avg(date_diff('day', sub, s)), 1) AS avg_lead_days FROM g GROUP BY 1")
def _(t):
    return _health(t).tables["sponsor_timing"]


# --- networks ---------------------------------------------------------------------------


def _publications(t):
    items = t("lineitem").select("l_orderkey", "l_suppkey")
    return items.repartition(tasks_for(items.count()), "l_orderkey").groupBy("l_orderkey").agg(
        F.array_join(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey"))), " ; ").alias("authors")
    )


def _entries(t):
    return network.author_rows(_publications(t), "authors", "l_orderkey")


# Publications sharing suppliers grow with the table; the minimum keeps the graph sparse.
MIN_SHARED = 30
ENTRIES = "m AS (SELECT DISTINCT l_orderkey AS p, 'S' || l_suppkey AS author FROM lineitem)"
EDGES = f"""{ENTRIES}, e AS (SELECT x.author AS a, y.author AS b, count(*) AS weight FROM m x JOIN m y ON x.p = y.p AND x.author < y.author
  GROUP BY ALL HAVING count(*) >= {MIN_SHARED})"""


@query("l8_author_rows", f"WITH {ENTRIES} SELECT author, p AS publication_id FROM m")
def _(t):
    return _entries(t)


@query("l9_coauthor_edges", f"WITH {EDGES} SELECT * FROM e")
def _(t):
    return network.coauthor_edges(_entries(t), MIN_SHARED)


@query("l10_degree_centrality", f"""
WITH {EDGES}, v AS (SELECT DISTINCT author FROM m), d AS (SELECT author, count(*) AS degree FROM (SELECT a AS author FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT author, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / ((SELECT count(*) FROM v) - 1), 6) AS degree_centrality FROM v LEFT JOIN d USING (author)""")
def _(t):
    entries = _entries(t)
    return network.degree_centrality(entries.select("author").distinct(), network.coauthor_edges(entries, MIN_SHARED))


@query("l10_network_counts", f"""
WITH {EDGES}, c AS (SELECT (SELECT count(DISTINCT author) FROM m) AS n, (SELECT count(*) FROM e) AS k)
SELECT n AS n_authors, k AS n_edges, round(2.0 * k / (n * (n - 1)), 6) AS density FROM c""")
def _(t):
    entries = _entries(t)
    return network.network_counts(entries.select("author").distinct(), network.coauthor_edges(entries, MIN_SHARED))


# Shortest paths from every author by recursion, one step a round; then each (from, over, to).
@query("l11_betweenness", f"""
WITH RECURSIVE {EDGES}, v AS (SELECT DISTINCT author FROM m),
arcs AS (SELECT a AS s, b AS t, false AS stay FROM e UNION ALL SELECT b, a, false FROM e UNION ALL SELECT author, author, true FROM v),
walk AS (SELECT 0 AS step, author AS src, author AS node, 0 AS dist, 1.0::DOUBLE AS paths FROM v
  UNION ALL
  SELECT step + 1, src, node, min(dist), arg_min(paths, dist) FROM (
    SELECT step, src, t AS node, CASE WHEN stay THEN dist ELSE step + 1 END AS dist, sum(paths) AS paths
    FROM walk JOIN arcs ON node = s WHERE step < 15 AND (stay OR dist = step) GROUP BY ALL) GROUP BY step, src, node),
d AS (SELECT src, node, dist, paths FROM walk WHERE step = 15),
b AS (SELECT x.node AS author, sum(x.paths * y.paths / z.paths) AS b FROM d x JOIN d y ON x.node = y.src JOIN d z ON z.src = x.src AND z.node = y.node
  WHERE x.dist > 0 AND y.dist > 0 AND x.dist + y.dist = z.dist GROUP BY 1)
SELECT author, round(coalesce(b, 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2), 6) AS betweenness_centrality FROM v LEFT JOIN b USING (author)""")
def _(t):
    entries = _entries(t)
    return network.betweenness(entries.select("author").distinct(), network.coauthor_edges(entries, MIN_SHARED))


@query("l12_coauthor_network")
def _(t):
    return network.coauthor_network(_publications(t), "authors", "l_orderkey").rows


# Customers who meet over their orders, of ten classes that never meet: the classes are the
# communities. A meeting has some ten orders however many there are, so pairs grow with orders.
MEETING = 10


@query("l12_planted_communities", """
SELECT DISTINCT 'C' || o_custkey AS author, min('C' || o_custkey) OVER (PARTITION BY o_custkey % 10) AS community_label FROM orders""")
def _(t):
    orders = t("orders")
    number = F.pmod(F.xxhash64("o_orderkey"), F.lit(orders.count() // (10 * MEETING) + 1)).cast("string")
    meetings = orders.groupBy(F.concat((F.col("o_custkey") % 10).cast("string"), F.lit("/"), number).alias("meeting")).agg(
        F.array_join(F.collect_set(F.concat(F.lit("C"), F.col("o_custkey"))), ";").alias("authors")
    )
    entries = network.author_rows(meetings, "authors", "meeting")
    return network.communities(entries.select("author").distinct(), network.coauthor_edges(entries))[0]


@query("l13_top_authors", f"""
WITH {EDGES}, v AS (SELECT DISTINCT author FROM m), d AS (SELECT author, count(*) AS degree FROM (SELECT a AS author FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT author, round(coalesce(degree, 0) / ((SELECT count(*) FROM v) - 1), 6) AS degree_centrality FROM v LEFT JOIN d USING (author)
ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    entries = _entries(t)
    degree = network.degree_centrality(entries.select("author").distinct(), network.coauthor_edges(entries, MIN_SHARED))
    return network.top_authors(degree)


# --- lineage ----------------------------------------------------------------------------


def _history(t):
    """Each order is a job that writes its own file and reads the one of the order before."""
    o = t("orders")
    key = F.col("o_orderkey").cast("string")
    source = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("s3://lost/"), key)).otherwise(
        F.concat(F.lit("s3://data/"), (F.col("o_orderkey") - 1).cast("string"))
    )
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("profile_id"),
        (F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, o_orderkey)")).alias("started_at"),
        source.alias("source_uri"),
        F.concat(F.lit("s3://data/"), key).alias("result_uri"),
        F.col("o_custkey").alias("user_id"),
    )


JOBS = """WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS profile_id, TIMESTAMP '1995-01-01' + to_minutes(o_orderkey) AS started_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 's3://lost/' || o_orderkey ELSE 's3://data/' || (o_orderkey - 1) END AS source_uri,
  's3://data/' || o_orderkey AS result_uri, o_custkey AS user_id FROM orders)"""


@query("l14_provenance", JOBS + """
SELECT job_id, profile_id, source_uri, result_uri, row_number() OVER (ORDER BY started_at) AS step
FROM j WHERE source_uri = 's3://data/123' OR result_uri = 's3://data/123'""")
def _(t):
    rows = lineage.provenance(_history(t), "s3://data/123").rows
    return rows.select("job_id", "profile_id", "source_uri", "result_uri", "step")


@query("l14_entities_two_hops", JOBS + """,
h AS (SELECT * FROM j WHERE source_uri = 's3://data/123' OR result_uri = 's3://data/123'),
u AS (SELECT source_uri AS uri FROM h UNION SELECT result_uri FROM h),
w AS (SELECT * FROM j WHERE source_uri IN (SELECT uri FROM u) OR result_uri IN (SELECT uri FROM u)),
r AS (SELECT source_uri AS uri, 'input' AS role, started_at, 0 AS pos FROM w UNION ALL SELECT result_uri, 'output', started_at, 1 FROM w)
SELECT uri, arg_min(role, (started_at, pos)) AS role, 'entity:' || uri AS id FROM r GROUP BY uri""")
def _(t):
    return lineage.provenance(_history(t), "s3://data/123", max_depth=2).tables["entities"]


@query("l15_lineage_gaps", JOBS + """,
p AS (SELECT *, row_number() OVER w - 1 AS stage, lag(result_uri) OVER w AS previous_result FROM j WINDOW w AS (PARTITION BY user_id ORDER BY started_at, job_id))
SELECT user_id, stage, job_id, previous_result, source_uri, 'Output ''' || previous_result || ''' does not match input ''' || source_uri || '''' AS description
FROM p WHERE previous_result <> source_uri""")
def _(t):
    return lineage.lineage_gaps(_history(t), ["user_id"])


@query("l16_prov_document", JOBS + """,
h AS (SELECT * FROM j WHERE source_uri = 's3://data/123' OR result_uri = 's3://data/123'),
r AS (SELECT source_uri AS uri, 'input' AS role, started_at, 0 AS pos FROM h UNION ALL SELECT result_uri, 'output', started_at, 1 FROM h),
e AS (SELECT uri, arg_min(role, (started_at, pos)) AS role FROM r GROUP BY uri)
SELECT 'entity' AS kind, 'entity:' || uri AS id, '{"id":"entity:' || uri || '","type":"prov:Entity","uri":"' || uri || '","role":"' || role || '"}' AS json FROM e
UNION ALL SELECT 'activity', 'activity:' || job_id, '{"id":"activity:' || job_id || '","type":"prov:Activity","profile_id":"' || profile_id ||
  '","startedAtTime":"' || strftime(started_at, '%Y-%m-%d %H:%M:%S') || '","wasAssociatedWith":"' || user_id || '"}' FROM h""")
def _(t):
    return lineage.provenance(_history(t), "s3://data/123").tables["prov_document"]


@query("l16_markdown", JOBS + """
SELECT row_number() OVER (ORDER BY started_at) AS step, '**Step ' || row_number() OVER (ORDER BY started_at) || '**: `' || profile_id || '` — ' || strftime(started_at, '%Y-%m-%d') AS line
FROM j WHERE source_uri = 's3://data/123' OR result_uri = 's3://data/123'""")
def _(t):
    return lineage.provenance(_history(t), "s3://data/123").tables["markdown"]


# --- power and reproducibility ----------------------------------------------------------

EFFECT = """
WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g LIMIT 1 OFFSET 1),
p AS (SELECT a.g AS group1, b.g AS group2, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS s, abs(a.m - b.m) AS d FROM a, b)"""


@query("l17_effect_size", EFFECT + """
SELECT 'value' AS outcome, 'event_type' AS treatment, group1, group2, round(s, 6) AS pooled_std, round(d / s, 6) AS effect_size FROM p""")
def _(t):
    return rounded(power.effect_sizes(t("events"), ["value"], ["event_type"]))


@query("l17_literature_effect", """
SELECT effect_size FROM (SELECT l_discount AS effect_size, row_number() OVER (ORDER BY l_discount) - 1 AS i, count(*) OVER () AS n FROM lineitem)
WHERE i = greatest(0, CAST(floor(n * 0.25) AS BIGINT) - 1)""")
def _(t):
    return power.literature_effect(t("lineitem"), "l_discount")


@query("l18_required_n", EFFECT + """
SELECT 'value' AS outcome, 'event_type' AS treatment, CAST(ceil(2 * ((1.9599639845400545 + 0.8416212335729143) / (d / s)) ** 2) AS BIGINT) AS required_n_per_group FROM p""")
def _(t):
    effects = power.effect_sizes(t("events"), ["value"], ["event_type"])
    return power.power_analysis(effects).rows.select("outcome", "treatment", "required_n_per_group")


@query("l18_power_curve")
def _(t):
    effects = power.effect_sizes(t("events"), ["value"], ["event_type"])
    return power.power_analysis(effects, exact=True).tables["power_curve"].select("outcome", "treatment", "n", "power")


def _reported(t):
    li = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit("v1").alias("release"))
    stated = li.agg(
        F.avg("l_quantity").cast("string").alias("l_quantity"),
        (F.avg("l_extendedprice") + 1).cast("string").alias("l_extendedprice"),
        (F.avg("l_discount") + 0.00001).cast("string").alias("l_discount"),
        F.max("release").alias("release"),
        F.lit("3").alias("unknown_metric"),
        F.lit(None).cast("string").alias("l_tax"),
    )
    return li, stated.unpivot([], stated.columns, "metric", "value")


@query("l19_reproducibility", """
SELECT 'l_quantity' AS metric, 'match' AS status, 0.0 AS delta, NULL AS error FROM (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'l_extendedprice', 'discrepancy', 1.0, NULL UNION ALL SELECT 'l_discount', 'match', 0.00001, NULL
UNION ALL SELECT 'release', 'match', NULL, NULL
UNION ALL SELECT 'unknown_metric', 'discrepancy', NULL, 'Metric ''unknown_metric'' not found in computed output'
UNION ALL SELECT 'l_tax', 'discrepancy', NULL, 'No ''value'' field in manuscript entry'""".replace("0.0 AS delta", "0.0::DOUBLE AS delta"))
def _(t):
    li, reported = _reported(t)
    return rounded(lineage.reproducibility_check(reported, li).rows.select("metric", "status", "delta", "error"), 8)


@query("l19_computed_means", """
SELECT 'l_quantity' AS metric, round(avg(l_quantity), 6) AS computed FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM lineitem""")
def _(t):
    li, reported = _reported(t)
    rows = lineage.reproducibility_check(reported, li).rows
    return rounded(rows.filter("computed is not null").select("metric", "computed"))

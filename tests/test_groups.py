"""Ledger, equity, cohorts, grants, transforms and comparison."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from statloom import ProfileResult
from statloom.operators import cohort, equity, grants, ledger, lineage, power, relational
from statloom.result import check_requirements
from tests.helpers import close, rows


def test_multi_join_prefixes_and_filters(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    c = spark.createDataFrame([(2, 0.5)], "k int, v double")
    result = relational.multi_join(a, [b, c], ["k"], "left", "src1_v >= 10", ["k", "v", "src1_v", "src2_v"])
    assert rows(result.rows) == [(1, "x", 10, None), (2, "y", 20, 0.5)]
    assert result.metrics.first()["row_count"] == 2
    with pytest.raises(ValueError):
        relational.multi_join(a, [b], [])
    with pytest.raises(ValueError):
        relational.multi_join(a, [b], ["k"], "cross")


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, val string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (4, "w")], "id int, val string")
    assert tuple(relational.snapshot_diff(a, b).metrics.first()) == (1, 1, 2)
    nulls = spark.createDataFrame([(None, "x"), (None, "x")], "id int, val string")
    assert tuple(relational.snapshot_diff(nulls, nulls.limit(1)).metrics.first()) == (0, 0, 1)
    assert tuple(relational.snapshot_diff(nulls, nulls.limit(1), multiset=True).metrics.first()) == (0, 1, 1)
    other = spark.createDataFrame([(1,)], "q int")
    assert tuple(relational.snapshot_diff(a, other).metrics.select("added", "removed", "unchanged").first()) == (1, 3, 0)


def test_schema_diff(spark):
    a = spark.createDataFrame([], "id int, col_a string, t int")
    b = spark.createDataFrame([], "id int, col_b string, t double")
    assert rows(relational.schema_diff(a, b), "column", "change") == [("col_a", "only_in_a"), ("col_b", "only_in_b"), ("t", "type_change")]


def test_chain_and_run_many(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(40)], "x double, g string")
    double = lambda d: ProfileResult(d.withColumn("x", F.col("x") * 2))
    out = relational.chain(df, double, double, costs=[0.1, 0.2])
    assert out.rows.agg(F.sum("x")).first()[0] == 4 * sum(range(40))
    assert close(out.tables["chain"].first()["total_cost"], 0.3)
    results, errors, shared = relational.run_many(df, {"gap": lambda d: equity.equity_gap(d, "x", ["g"]), "bad": lambda d: equity.equity_gap(d, "no", ["g"])}, ["gap", "bad", "none"])
    assert set(results) == {"gap"} and set(errors) == {"bad", "none"} and "available" in errors["none"]
    shared.unpersist()


def test_requirements(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    assert check_requirements(df, {"m": "x"}, ["m"], column_types={"m": "numeric"})["columns_checked"] == ["x"]
    with pytest.raises(ValueError):
        check_requirements(df, {"m": "g"}, ["m"], column_types={"m": "numeric"})
    with pytest.raises(ValueError):
        check_requirements(df, {"m": "x"}, ["m"], min_rows=5)


def test_standardize_constant(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    assert rows(relational.standardize(df, ["a", "b"]), "a_scaled", "b_scaled") == [(0.0, -1.0), (0.0, 1.0)]


def test_split_is_stable(spark):
    df = spark.range(5000)
    a = relational.train_test_flag(df, ["id"])
    b = relational.train_test_flag(df.repartition(7).orderBy(F.rand()), ["id"])
    assert a.exceptAll(b).count() == 0
    assert 850 < a.filter("is_test").count() < 1150


def _jobs(spark):
    data = [
        (1, "u", "p", "2024-01-01 10:00:00", 30.0, 1.0), (2, "u", "p", "2024-01-02 10:00:00", None, 12.0),
        (3, "u", "q", "2024-01-03 10:00:00", -5.0, 1.0), (4, "v", "q", "2024-02-01 10:00:00", 40.0, 1.0),
        (5, "u", "q", "2024-02-01 10:00:00", 1.0, 1.0),
    ]
    return spark.createDataFrame(data, "job_id int, user_id string, profile_id string, started_at string, cost double, estimated_cost double").withColumn(
        "started_at", F.col("started_at").cast("timestamp_ntz")
    )


def test_spend_and_alerts(spark):
    jobs = _jobs(spark)
    spend = ledger.monthly_spend(jobs).rows
    assert rows(spend, "user_id", "month", "spend") == [("u", "2024-01", 42.0), ("u", "2024-02", 1.0), ("v", "2024-02", 40.0)]
    alerts = ledger.budget_alerts(jobs, 50.0).rows
    assert rows(alerts, "user_id", "job_id") == [("u", 2), ("v", 4)]  # 40 of 50 is exactly the threshold
    requests = spark.createDataFrame([("u", "2024-01", 8.0), ("u", "2024-01", 8.5), ("w", "2024-01", 50.0)], "user_id string, month string, estimated_cost double")
    assert rows(ledger.budget_gate(requests, spend, 50.0).rows, "projected_spend", "budget_ok") == [(50.0, True), (50.0, True), (50.5, False)]


@pytest.mark.parametrize("size", [None, 2])
def test_alerts_cut_along_time(spark, size):
    data = [(i, "hot", i, 1.0) for i in range(100)] + [(200 + i, f"u{i}", i, 30.0) for i in range(10)]
    jobs = spark.createDataFrame(data, "job_id int, user_id string, t int, cost double").withColumn(
        "started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz")
    )
    assert rows(ledger.budget_alerts(jobs, 50.0, rows_per_bucket=size).rows, "user_id", "job_id") == [("hot", 39)]


def test_history_pages(spark):
    jobs = _jobs(spark)
    first = ledger.job_history(jobs, "u", 2)
    assert [r["job_id"] for r in first.rows.orderBy("position").collect()] == [5, 3]
    token = first.metrics.first()["next_cursor"]
    second = ledger.job_history(jobs, "u", 2, token)
    assert [r["job_id"] for r in second.rows.orderBy("position").collect()] == [2, 1]
    assert second.metrics.first()["next_cursor"] is None
    assert ledger.job_history(jobs, "u", 2, "garbage").rows.count() == 2
    for size in (0, 21, "5", None):
        with pytest.raises(ValueError, match="1 to 20"):
            ledger.job_history(jobs, "u", size)
    with pytest.raises(ValueError, match="1 to 50"):
        ledger.list_snapshots(jobs, "u", 51)


def test_alerts_at_a_total_that_equals_the_mark(spark):
    data = [(i, "u", i, 0.1) for i in range(10)]  # eight times 0.1 is less than 0.8 in doubles
    jobs = spark.createDataFrame(data, "job_id int, user_id string, t int, cost double").withColumn(
        "started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz")
    )
    for size in (None, 2, 3):
        assert rows(ledger.budget_alerts(jobs, 1.0, rows_per_bucket=size).rows, "job_id", "spend_before", "spend_after") == [(7, 0.7, 0.8)]


def test_concurrent_jobs(spark):
    data = [("u", 0, 10), ("u", 5, 15), ("u", 10, 20), ("u", 12, None)]
    jobs = spark.createDataFrame(data, "user_id string, s int, e int").select(
        "user_id", *[F.timestamp_seconds(F.lit(0) + F.col(c)).cast("timestamp_ntz").alias(n) for c, n in (("s", "started_at"), ("e", "ended_at"))]
    )
    for size in (None, 2):
        assert ledger.concurrent_jobs(jobs, 2, rows_per_bucket=size).tables["peak"].first()["peak_running"] == 3


def test_estimates_are_clamped(spark):
    profiles = spark.createDataFrame([("p", 0.01, 10.0), ("q", 0.5, 100.0)], "profile_id string, typical_cost double, typical_seconds double")
    requests = spark.createDataFrame([("p", 0, None), ("p", 1, "q"), ("p", 10**10, None)], "profile_id string, size_bytes long, next string")
    got = ledger.estimate_cost(requests, profiles, chain_column=None).rows
    assert rows(got, "size_bytes", "estimated_cost") == [(0, 0.01), (1, 0.001), (10000000000, 0.1)]
    chained = ledger.estimate_cost(requests, profiles, chain_column="next").rows.filter("next = 'q'").first()
    assert close(chained["estimated_cost"], 0.501) and close(chained["estimated_seconds"], 101.0)


def test_estimates_of_events_without_a_value(spark, tmp_path):
    data = [(0, 1, "view", 0.0), (1, 1, "view", 10.48576), (2, 1, "view", None)]
    events = spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double").withColumns(
        {"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "props": F.lit("{}")}
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["d8_estimate_cost"](spark, str(tmp_path))
    assert rows(got, "job_id", "estimated_cost", "estimated_seconds") == [(0, 0.0004, 2.0), (1, 0.004, 20.0), (2, 0.0004, 2.0)]


def test_failures(spark):
    df = spark.createDataFrame(
        [("p", "E1", '{"errorMessage": "boom"}'), ("p", "E1", "plain text"), ("p", None, ""), ("p", "E2", None)], "profile_id string, error_code string, cause string"
    )
    assert rows(ledger.failure_summary(df).rows, "error_message") == [
        ("Job failed with error: E2",), ("Job failed with error: UnknownError",), ("boom",), ("plain text",)
    ]


def test_equity_reference_and_small_groups(spark):
    data = [(3.0, "n")] * 12 + [(2.4, "y")] * 12 + [(9.0, "rare")] * 2 + [(1.0, None)] * 4 + [(None, "y")]
    df = spark.createDataFrame(data, "gpa double, pell string")
    result = equity.equity_gap(df, "gpa", ["pell"], "n")
    table = {r["pell"]: r for r in result.tables["gap_table"].collect()}
    assert table["n"]["equity_index"] == 1.0 and close(table["y"]["equity_index"], 0.8)
    assert set(table) == {"n", "y"}
    assert result.metrics.first()["n_groups_excluded_small"] == 1
    assert result.rows.count() == df.count()
    assert result.rows.filter("pell = 'rare'").first()["group_mean"] is None
    overall = equity.equity_gap(df, "gpa", ["pell"], "missing").metrics.first()
    assert overall["reference_mean"] == overall["overall_mean"]


def test_dfwi_rates(spark):
    grades = [(g, "ABCDE"[i % 5]) for i, g in enumerate(["A", "B", "C", "D", "F", "W", "A", "B", "F", "W"] * 10)]
    result = equity.dfwi(spark.createDataFrame(grades, "grade string, course string"), "grade")
    assert result.metrics.first()["overall_dfwi_rate"] == 0.5
    custom = equity.dfwi(spark.createDataFrame([("P",), ("NP",)] * 10, "grade string"), "grade", ["NP"])
    assert custom.tables["dfwi_summary"].first()["dfwi_rate"] == 0.5
    assert equity.dfwi(spark.createDataFrame([(None,), ("F",)], "grade string"), "grade").rows.filter("is_dfwi").count() == 1


def test_peer_benchmark(spark):
    df = spark.createDataFrame([(i, v) for i, v in zip("ABCDE", [1.0, 2.0, 2.0, 5.0, None])], "unit string, rate double")
    result = equity.peer_benchmark(df, ["rate"], "unit", "C")
    got = {r["unit"]: r for r in result.rows.collect()}
    assert close(got["C"]["rate_percentile"], 62.5) and close(got["B"]["rate_percentile"], 62.5)
    assert got["E"]["rate_zscore"] is None and got["C"]["is_focal"]
    assert close(got["D"]["rate_zscore"], round(2.5 / np.std([1, 2, 2, 5]), 4))
    assert "not found" in equity.peer_benchmark(df, ["rate"], "unit", "Z").metrics.first()["note"]


def test_find_peers(spark):
    data = [("A", "R1", "pub", 1000, 30.0), ("B", "R1", "pub", 1100, 32.0), ("C", "R1", "pub", 900, 25.0), ("D", "R2", "pub", 1000, 30.0), ("E", "R1", "pub", 5000, 30.0)]
    df = spark.createDataFrame(data, "unit_id string, carnegie_class string, control_type string, total_enrollment int, pell_pct double")
    assert [r["unit_id"] for r in equity.find_peers(df, "A").rows.collect()] == ["B", "C"]
    assert equity.find_peers(df, "Z").rows.count() == 0


def test_intersectionality(spark):
    data = [(2.5, "y", "y")] * 20 + [(3.4, "n", "n")] * 20 + [(3.4, "n", "y")] * 3
    result = equity.intersectionality(spark.createDataFrame(data, "gpa double, a string, b string"), "gpa", ["a", "b"], ["n", "n"])
    got = {r["group_key"]: r for r in result.rows.collect()}
    assert got["y|y"]["adverse_impact_flag"] and got["n|n"]["di_ratio"] == 1.0
    assert got["n|y"]["n"] is None and got["n|y"]["n_display"] == "<10" and got["n|y"]["di_ratio"] is None
    edge = spark.createDataFrame([(0.8, "a", "x")] * 10 + [(1.0, "b", "x")] * 10, "m double, a string, b string")
    exact = equity.intersectionality(edge, "m", ["a", "b"], ["b", "x"]).rows.filter("group_key = 'a|x'").first()
    assert exact["adverse_impact_flag"] is False  # exactly four fifths is not adverse


def test_retention_label_order(spark):
    data = [(1, "c", "2023-09-01"), (1, "c", "2024-02-01"), (2, "c", "2024-03-01"), (2, "c", "2024-03-05"), (1, "c", "2024-10-01")]
    df = spark.createDataFrame(data, "id int, cohort string, day string")
    got = {r["period"]: r["retention_rate"] for r in cohort.retention(df, "id", "cohort", "day").rows.collect()}
    assert got == {"2023-Fall": 1.0, "2024-Fall": 1.0, "2024-Spring": 1.0}  # two of one are clipped to one
    last = cohort.retention(df.filter("day > '2024'"), "id", "cohort", "day", period_order="chronological").rows
    assert {r["period"]: r["retention_rate"] for r in last.collect()} == {"2024-Spring": 1.0, "2024-Fall": 0.5}


def test_funnel_counts(spark):
    stages = ["applied", "admitted", "enrolled", "graduated"]
    data = [(i, s) for i in range(100) for s, n in zip(stages, (100, 80, 60, 40)) if i < n] + [(500, "other")]
    result = cohort.cohort_flow(spark.createDataFrame(data, "sid int, stage string"), "sid", "stage", stages)
    table = result.tables["funnel"].orderBy("stage_order").collect()
    assert [r["n_reached"] for r in table] == [100, 80, 60, 40]
    assert [r["conversion_from_previous"] for r in table] == [1.0, 0.8, 0.75, 0.6667]
    assert result.rows.count() == len(data)
    assert result.rows.filter("sid = 500").first()["stage_reached"] is None


def test_funnel_does_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "id int, stage string, cohort string")
    result = cohort.cohort_flow(df, "id", "stage", ["a", "b"], "cohort")
    assert rows(result.rows, "cohort", "stage_reached") == [("x", "a"), ("y", "b")]


def test_burn_rates(spark):
    data = [("A1", 20000.0, 100000.0, "2024-01-01"), ("A1", 25000.0, 100000.0, "2024-02-01"), ("A2", 80000.0, 100000.0, "2024-01-15"), ("A3", 5.0, 0.0, "2024-01-01"), (None, 5.0, 1.0, "2024-01-01")]
    df = spark.createDataFrame(data, "award string, amount double, budget double, date string")
    result = grants.grant_portfolio(df, "amount", "budget", "date", "award", nce_threshold=0.8)
    got = {r["award_id"]: r for r in result.tables["portfolio_summary"].collect()}
    assert got["A1"]["burn_rate"] == 0.45 and got["A2"]["burn_rate"] == 0.8 and got["A3"]["burn_rate"] is None
    assert not got["A2"]["nce_risk"]  # exactly the threshold is no risk
    assert result.metrics.first()["rows_excluded_missing_data"] == 1
    assert result.rows.count() == 5
    slices = spark.createDataFrame([("S", 10.0, 40.0, "2024-01-01"), ("S", 10.0, 60.0, "2024-01-02")], "award string, amount double, budget double, date string")
    assert grants.grant_portfolio(slices, "amount", "budget", "date", "award").tables["portfolio_summary"].first()["total_budget"] == 100.0


def test_pi_health(spark):
    data = [("Ann", "2023-01-01", "2026-01-01", "N", 10), ("Bob", "2023-01-01", "2024-02-15", "N", 20), ("Bob", "2020-01-01", "2021-01-01", "M", 30)]
    df = spark.createDataFrame(data, "pi string, s string, e string, sponsor string, amount int")
    result = grants.pi_health(df, "pi", "s", "e", "amount", "sponsor", as_of="2024-01-01")
    got = {r["pi"]: r for r in result.rows.collect()}
    assert got["Bob"]["ending_soon"] == 1 and got["Ann"]["funding_gap_months"] == 0 and got["Bob"]["funding_gap_months"] == 10
    assert close(got["Ann"]["health_score"], round(1 / 3 * 0.4 + 0.4 + 0.2 * 0.2, 3))
    assert tuple(result.tables["portfolio_summary"].first()) == (2, 30.0, 2)


def test_lineage_gaps_and_document(spark):
    data = [(1, "p", "2024-01-01", "in", "x"), (2, "q", "2024-01-02", "x", "y"), (3, "r", "2024-01-03", "z", "x"), (4, "s", "2024-01-04", "other", "far")]
    history = spark.createDataFrame(data, "job_id int, profile_id string, started_at string, source_uri string, result_uri string").withColumn(
        "started_at", F.col("started_at").cast("timestamp_ntz")
    )
    result = lineage.provenance(history, "x")
    assert result.metrics.first()["activities_found"] == 3
    assert rows(result.tables["gaps"], "stage", "previous_result", "source_uri") == [(2, "y", "z")]
    assert {r["uri"]: r["role"] for r in result.tables["entities"].collect()} == {"in": "input", "x": "output", "y": "output", "z": "input"}
    assert [r["line"] for r in result.tables["markdown"].collect()][0] == "**Step 1**: `p` — 2024-01-01"


def test_reproducibility(spark):
    computed = spark.createDataFrame([(1.0, "a"), (3.0, "a")], "x double, tag string")
    reported = spark.createDataFrame([("x", "2.0001"), ("tag", "a"), ("none", "1"), ("x", None)], "metric string, value string")
    got = lineage.reproducibility_check(reported, computed, 0.00011).rows
    assert rows(got, "metric", "status") == [("none", "discrepancy"), ("tag", "match"), ("x", "discrepancy"), ("x", "match")]


def test_power(spark):
    effects = power.manual_effect(spark, 0.5)
    normal = power.power_analysis(effects)
    assert normal.rows.first()["required_n_per_group"] == 63
    exact = power.power_analysis(effects, exact=True)
    assert exact.rows.first()["required_n_per_group"] == 64  # the textbook value
    curve = {r["n"]: r["power"] for r in exact.tables["power_curve"].collect()}
    assert len(curve) == 99 and abs(curve[64] - 0.8014) < 1e-3
    with pytest.raises(ValueError):
        power.manual_effect(spark, 0)


def test_pilot_effect(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"y": np.concatenate([rng.normal(10, 2, 30), rng.normal(12, 2, 30)]), "g": ["a"] * 30 + ["b"] * 30})
    a, b = pdf.y[:30], pdf.y[30:]
    want = abs(a.mean() - b.mean()) / np.sqrt((29 * a.var() + 29 * b.var()) / 58)
    assert close(power.effect_sizes(spark.createDataFrame(pdf), ["y"], ["g"]).first()["effect_size"], want)
    studies = spark.createDataFrame([(v,) for v in (0.9, 0.1, 0.5, 0.3, 0.7, 0.2, 0.8, 0.4)], "effect_size double")
    assert power.literature_effect(studies).first()["effect_size"] == 0.2


def test_aid_bands(spark):
    rng = np.random.RandomState(0)
    data = [(i, 2020 + i % 2, float(e), 1000.0, 500.0 + i % 7, int(rng.rand() < 0.6)) for i, e in enumerate(rng.uniform(2000, 20000, 200))]
    df = spark.createDataFrame(data, "student_id int, aid_year int, efc double, total_grants double, total_loans double, persistence_flag int")
    result = equity.financial_aid(df.withColumn("total_grants", F.col("total_grants") + F.col("student_id") % 3))
    assert set(r["aid_band"] for r in result.tables["cohort_table"].collect()) == {"<$5k", "$5-10k", "$10-15k", ">$15k"}
    assert result.rows.filter("predicted_persistence_prob between 0 and 1").count() == 200
    assert [r["aid_year"] for r in result.tables["unmet_need_trend"].collect()] == ["2020", "2021"]

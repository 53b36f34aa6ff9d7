"""Registration, the flagship query, and the plans of central queries."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from statloom.operators import network

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["orderkey", "l_linenumber", "l_partkey", "l_quantity", "src1_o_orderstatus", "src1_c_mktsegment"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


def test_filters_and_columns_reach_the_scans(spark):
    text = plan(entry.queries()["c1_multi_join"](spark, SMALL))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(l_quantity,10.0)" in text
    scans = [line for line in text.splitlines() if "ReadSchema" in line]
    assert len(scans) == 3 and not any("l_tax" in s or "o_totalprice" in s or "c_acctbal" in s for s in scans)


def test_top_rows_per_user_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["d1_job_history"](spark, SMALL))


@pytest.mark.parametrize("name", ["j1_equity_gap_table", "d3_monthly_spend", "i5_retention", "c7_snapshot_diff", "l5_pi_health"])
def test_aggregates_are_partial_and_windows_absent(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "partial_" in text and "Window" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["h10_fill_forward", "h10_fill_linear"])
def test_no_row_reads_the_rest_of_its_series(spark, name):
    text = plan(entry.queries()[name](spark, SMALL)).lower()
    assert "window" in text and "unboundedfollowing" not in text


def test_meetings_of_planted_communities_do_not_grow_with_the_orders(spark, monkeypatch):
    seen = []

    def edges(entries):
        sizes = entries.groupBy("publication_id").agg(F.count("*").alias("n"))
        seen.append(sizes.agg(F.max("n"), F.sum("n")).first())
        raise StopIteration

    monkeypatch.setattr(network, "coauthor_edges", edges)
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        with pytest.raises(StopIteration):
            entry.queries()["l12_planted_communities"](spark, folder)
    (_, few), (largest, many) = seen
    assert largest < 50 and many > 9 * few


def test_the_network_has_every_pair_of_authors_of_a_publication(spark, monkeypatch, tmp_path):
    items = [(1, 10), (1, 11), (2, 11), (2, 12), (2, 12), (3, 10), (3, 11), (4, 13)]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []

    def between(vertices, edges, **_):
        seen.extend((r["a"], r["b"], r["weight"]) for r in edges.collect())
        raise StopIteration

    monkeypatch.setattr(network, "betweenness", between)
    with pytest.raises(StopIteration):
        entry.queries()["l12_coauthor_network"](spark, str(tmp_path))
    assert sorted(seen) == [("S10", "S11", 2), ("S11", "S12", 1)]


def test_running_totals_are_partitioned_by_bucket(spark):
    text = plan(entry.queries()["d5_budget_alerts"](spark, SMALL))
    assert "_bucket" in text or "month" in text
    assert "Cartesian" not in text

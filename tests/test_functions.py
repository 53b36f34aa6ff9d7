"""Shared functions against brute force, with buckets forced small."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.components import connected_components
from statloom.functions.missing import complete_cases, epoch_seconds, moment, number
from statloom.functions.ordered import average_ranks, exact_quantile, find_cuts, numbered, previous_row, running_sums
from statloom.functions.series import pelt, stl
from tests.helpers import close, rows


def hot_table(spark, n=600, seed=1):
    """One key holds most rows; a third of the order values are equal."""
    rnd = random.Random(seed)
    data = [
        (i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), 7 if rnd.random() < 0.34 else rnd.randrange(40), rnd.random())
        for i in range(n)
    ]
    return pd.DataFrame(data, columns=["id", "k", "t", "v"]), spark.createDataFrame(data, "id long, k string, t int, v double")


@pytest.mark.parametrize("size", [None, 25])
def test_running_sums_match_window(spark, size):
    pdf, df = hot_table(spark)
    out = running_sums(df, ["k"], ["t", "id"], {"total": F.col("v")}, rows_per_bucket=size).toPandas().set_index("id")["total"]
    want = pdf.sort_values(["t", "id"]).groupby("k")["v"].cumsum()
    assert np.allclose(out.sort_index(), want.sort_index())


def test_heavy_ties_are_cut_on_the_second_column(spark):
    _, df = hot_table(spark)
    cuts = find_cuts(df, ["t", "id"], 25)
    assert cuts.heavy and cuts.inner


@pytest.mark.parametrize("size", [None, 25])
def test_previous_row(spark, size):
    pdf, df = hot_table(spark)
    out = previous_row(df, ["k"], ["t", "id"], {"before": "id"}, rows_per_bucket=size).toPandas().set_index("id")["before"]
    want = pdf.sort_values(["t", "id"]).groupby("k")["id"].shift()
    assert out.sort_index().fillna(-1).tolist() == want.sort_index().fillna(-1).tolist()


@pytest.mark.parametrize("size", [None, 5])
def test_ranks_and_quantiles(spark, size):
    pdf, df = hot_table(spark)
    ranks = average_ranks(df, "t", ["k"], rows_per_bucket=size).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["t"].rank()).drop_duplicates(["k", "t"]).set_index(["k", "t"])["r"]
    assert np.allclose(ranks.set_index(["k", "t"])["avg_rank"].sort_index(), want.sort_index())
    for q in (0.0, 0.37, 0.5, 1.0):
        got = exact_quantile(df, "v", ["k"], q, "q", size).toPandas().set_index("k")["q"]
        assert np.allclose(got.sort_index(), pdf.groupby("k")["v"].quantile(q).sort_index())


def test_quantile_without_keys_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "v double")
    assert exact_quantile(df, "v").first()["quantile"] == 3.0


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("label"))
    assert rows(numbered(df.union(df), "label", "no").orderBy("label")) == rows(
        spark.range(50).select((F.col("id") * 3).alias("label"), F.col("id").alias("no"))
    )


def test_missing_values(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("x", float("nan")), (None, 2.0)], "a string, b double")
    got = df.select(number(df, "a").alias("a"), number(df, "b").alias("b")).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.0), (None, None), (None, 2.0)]
    assert complete_cases(df, ["a", "b"]).filter("is_complete").count() == 1


def test_dates_from_text(spark):
    df = spark.createDataFrame([("2024-01-02",), ("no date",)], "d string")
    got = [r[0] for r in df.select(epoch_seconds(moment(df, "d"))).collect()]
    assert got == [1704153600.0, None]


def test_tail_probabilities():
    # tabulated values
    assert close(dist.t_two_sided(2.228138852, 10), 0.05, 1e-7)
    assert close(dist.f_tail(4.102821, 2, 10), 0.05, 1e-5)
    assert close(dist.chi2_tail(3.841458821, 1), 0.05, 1e-7)
    assert close(dist.normal_two_sided(1.959963985), 0.05, 1e-7)
    assert close(dist.chi2_tail(30.0, 8), math.exp(-15) * sum(15**i / math.factorial(i) for i in range(4)), 1e-10)
    assert dist.t_two_sided(math.nan, 5) is None and dist.f_tail(1.0, 0, 5) is None


def test_components_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 30)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def _best_partition(x, penalty, min_size, jump=5):
    n = len(x)
    ends = [i for i in range(0, n, jump) if i >= min_size] + [n]
    cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
    best = {0: (0.0, [])}
    for e in ends:
        options = [
            (best[s][0] + cost(s, e) + penalty, best[s][1] + [e]) for s in best if s < e and e - s >= min_size and s % jump == 0
        ]
        if options:
            best[e] = min(options, key=lambda o: o[0])
    return best[n][1][:-1]


def test_pelt_finds_the_optimal_partition():
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.randn(40), rng.randn(35) + 6, rng.randn(30) - 3, rng.randn(23) + 1])
    for penalty in (5.0, 20.0, 400.0):
        assert pelt(x, "l2", 3, penalty) == _best_partition(x, penalty, 3)
    step = np.concatenate([np.full(20, 10.0), np.full(20, 20.0)]) + rng.randn(40) * 0.1
    assert pelt(step, "l1", 3, 5.0) == [20]
    assert pelt(step, "rbf", 3, 1.0) == [20]
    assert pelt(np.ones(4), "l2", 3, 1.0) == []


def test_stl_recovers_line_and_wave():
    t = np.arange(96)
    wave = 10 * np.sin(2 * np.pi * t / 12)
    trend, seasonal, residual = stl(100 + 0.5 * t + wave, 12)
    assert np.abs(seasonal - wave)[6:-6].max() < 0.2
    assert np.abs(trend - (100 + 0.5 * t))[6:-6].max() < 0.2
    spiked = 100 + 0.5 * t + wave
    spiked[50] += 80
    assert stl(spiked, 12)[2][50] > 70  # a spike stays in the residual

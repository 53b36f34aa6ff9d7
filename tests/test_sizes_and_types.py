"""The same answer for any bucket size, type of id and layout, and cases that used to depend on size."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.ordered import previous_row, running_sums
from statloom.operators import anomaly, causal, cluster, geo, ledger, lineage, relational, survival, text, timeseries
from statloom.sources import ingest, readers, writers
from tests.helpers import rows

SIZES = [5, 50, None]


def jobs(spark, n=200, moments=1):
    """A ledger with text ids and text times, many of them equal."""
    data = [(f"job-{i * 7919 % n:04d}", f"u{i % 3}", f"2024-01-{1 + i % moments:02d}T08:00:00", 10.0 + i % 5, f"s3://{i}", f"s3://{i + i % 2}") for i in range(n)]
    return spark.createDataFrame(data, "job_id string, user_id string, started_at string, cost double, source_uri string, result_uri string").withColumn("profile_id", F.lit("p"))


@pytest.mark.parametrize("moments", [1, 9])
def test_alerts_with_text_ids(spark, moments):
    df = jobs(spark, moments=moments).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    found = [rows(ledger.budget_alerts(df.repartition(n), 100.0, rows_per_bucket=size).rows, "user_id", "job_id", "spend_after") for n, size in zip((1, 3, 5), SIZES)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


@pytest.mark.parametrize("moments", [1, 9])
def test_lineage_with_text_ids_and_times(spark, moments):
    df = jobs(spark, moments=moments)
    gaps = [rows(lineage.lineage_gaps(df.repartition(n), rows_per_bucket=size)) for n, size in zip((1, 3, 5), SIZES)]
    assert gaps[0] == gaps[1] == gaps[2] and gaps[0]
    steps = [rows(lineage.provenance(df, "s3://5", max_depth=2, rows_per_bucket=size).rows, "step", "job_id") for size in (1, 5, None)]
    assert steps[0] == steps[1] == steps[2] and steps[0]


def test_running_sums_over_text_order(spark):
    data = [(i % 2, f"k{i * 37 % 300:03d}", i) for i in range(300)] + [(0, None, 1000)]
    df = spark.createDataFrame(data, "g int, k string, v long")
    wanted = {}
    for g in (0, 1):
        total = 0
        for _, k, v in sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or "")):
            wanted[g, k] = total
            total += v
    for size in (7, 50, None):
        got = running_sums(df, ["g"], ["k"], {"before": F.col("v")}, inclusive=False, rows_per_bucket=size)
        assert {(r["g"], r["k"]): r["before"] for r in got.collect()} == wanted
    before = [rows(previous_row(df, ["g"], ["k"], {"last": "v"}, rows_per_bucket=size), "g", "k", "last") for size in (7, None)]
    assert before[0] == before[1]


def test_gaps_with_text_ids_on_one_date(spark):
    data = [(f"r{i * 13 % 60:02d}", "2024-01-01", float(i) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(data, "id string, d string, v double")
    found = [rows(timeseries.fill_gaps(df, "d", "v", "id", method=m, rows_per_bucket=size).rows) for m in ("ffill", "linear") for size in (6, None)]
    assert found[0] == found[1] and found[2] == found[3]


def test_sentiment_of_a_long_text(spark):
    long_text = "not very good but " * 20_000
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    got = text.sentiment(spark.createDataFrame([(1, long_text), (2, "good")], "id int, t string"), "t", lexicon).rows.collect()
    assert {r["id"]: r["sentiment"] for r in got} == {1: "negative", 2: "positive"}


def test_origins_without_coordinates_are_none(spark):
    points = spark.createDataFrame([(40.0, -75.0), (None, 1.0)], "lat double, lon double")
    origins = spark.createDataFrame([("BAD", None, None), ("A", 40.1, -75.1), ("HALF", 40.0, None)], "label string, lat double, lon double")
    for few in (10, 0):
        result = geo.isochrone(points, "lat", "lon", origins, broadcast_origins=few)
        assert [r["nearest_origin"] for r in result.rows.orderBy("lat").collect()] == [None, "A"]
        assert tuple(result.tables["origins"].first()) == (3, 2)


def square(name, x):
    ring = [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_polygons_one_per_line_and_over_files(spark, tmp_path):
    folder = tmp_path / "polygons"
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(square(f"p{n}{i}", 10 * n + 2 * i)) for i in range(2)))
    polygons = ingest.read_polygons(spark, str(folder), lines=True)
    assert rows(polygons, "polygon_id", "polygon_label") == [(0, "p00"), (1, "p01"), (2, "p10"), (3, "p11")]
    points = spark.createDataFrame([(0.5, 0.5, 1.0), (0.5, 2.5, 2.0), (0.5, 10.5, 3.0), (0.6, 10.6, 5.0)], "lat double, lon double, v double")
    summary = geo.spatial_aggregate(points, "lat", "lon", polygons, ["v"], ["mean", "median"]).tables["polygon_summary"]
    assert rows(summary, "polygon_label", "n", "v_median") == [("p00", 1, 1.0), ("p01", 1, 2.0), ("p10", 2, 4.0)]


def test_density_of_huge_bins(spark):
    assert spark.range(1).select(F.pow(F.lit(4_000_000_000).cast("double"), F.lit(2.0))).first()[0] == 1.6e19
    df = spark.createDataFrame([(float(i % 40) - 20, float(i)) for i in range(400)], "rv double, y double")
    assert causal.causal_rd(df, "y", "rv", 0.0).metrics.first() is not None


def test_export_is_whole_unless_limited(spark, tmp_path):
    df = spark.range(50).repartition(3)
    writers.export_csv(df, str(tmp_path / "all"))
    writers.export_csv(df, str(tmp_path / "some"), 5, ["id"])
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    assert read("all").count() == 50 and rows(read("some")) == [(str(i),) for i in range(5)]


def test_manifest_lines_come_from_a_table(spark, tmp_path):
    uris = spark.range(20).select(F.concat(F.lit(str(tmp_path) + "/x/"), F.col("id").cast("string")).alias("u")).repartition(4)
    writers.write_manifest(spark, str(tmp_path / "m"), uris)
    lines = spark.read.json(str(tmp_path / "m"))
    assert lines.count() == 20 and lines.select("globalUploadSettings.format").distinct().first()[0] == "PARQUET"


def test_every_class_keeps_its_share(spark):
    df = spark.createDataFrame([(i, "rare" if i % 50 == 0 else "common" if i % 3 else "some") for i in range(1000)] + [(5000, "single"), (5001, None)], "id int, c string")
    flagged = relational.train_test_flag(df, ["id"], 0.2, stratify="c")
    found = {r["c"]: (r["n"], r["t"]) for r in flagged.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert found["single"] == (1, 0) and found[None] == (1, 0)
    for c in ("rare", "common", "some"):
        n, t = found[c]
        assert abs(t - 0.2 * n) <= 1
    assert rows(flagged.repartition(7)) == rows(relational.train_test_flag(df.repartition(5), ["id"], 0.2, stratify="c"))


def test_logrank_of_many_groups_in_blocks(spark):
    df = spark.createDataFrame([(i % 40, float(i * 7 % 90), int(i % 3 != 0)) for i in range(2000)], "g int, t double, e int")
    whole = survival.logrank(df, "t", "e", "g").first()
    cut = survival.logrank(df, "t", "e", "g", rows_per_bucket=300).first()
    assert whole["degrees_of_freedom"] == 39 and abs(whole["test_statistic"] - cut["test_statistic"]) < 1e-8


def direct_logrank(t, e, g):
    """The statistic by the whole covariance matrix, and its degrees of freedom."""
    names, at = np.unique(g, return_inverse=True)
    k = len(names)
    z, v = np.zeros(k), np.zeros((k, k))
    for u in np.unique(t[e == 1]):
        risk = np.bincount(at[t >= u], minlength=k).astype(float)
        dead = np.bincount(at[(t == u) & (e == 1)], minlength=k).astype(float)
        n, d = risk.sum(), dead.sum()
        z += dead - d * risk / n
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(risk / n) - np.outer(risk, risk) / n**2)
    return z @ np.linalg.pinv(v, rcond=1e-12) @ z, k - 1


@pytest.mark.parametrize("size", [None, 60])
def test_logrank_equals_the_direct_form(spark, size):
    rng = np.random.RandomState(4)
    n = 900
    g = rng.randint(0, 20, n)
    # groups differ in length and censoring; group 20 leaves before the first event, group 21 stays alone to the end
    t = np.concatenate([1 + np.floor(rng.exponential(5 + g * 3)), [0.5] * 6, [500.0] * 5])
    e = np.concatenate([(rng.rand(n) < 0.3 + g / 40).astype(int), [0] * 6, [1] * 5])
    g = np.concatenate([g, [20] * 6, [21] * 5])
    want, df = direct_logrank(t, e, g)
    table = spark.createDataFrame(list(zip(g.tolist(), t.tolist(), e.tolist())), "g int, t double, e int")
    got = survival.logrank(table, "t", "e", "g", rows_per_bucket=size).first()
    assert got["degrees_of_freedom"] == df == 21 and abs(got["test_statistic"] - want) < 1e-8 * want


def test_logrank_without_events_or_with_one_group(spark):
    calm = spark.createDataFrame([(i % 3, float(i % 7), 0) for i in range(60)], "g int, t double, e int")
    row = survival.logrank(calm, "t", "e", "g").first()
    assert (row["test_statistic"], row["degrees_of_freedom"], row["significant"]) == (0.0, 2, False) and row["p_value"] == 1.0
    assert survival.logrank(calm.withColumn("g", F.lit(1)), "t", "e", "g").count() == 0


def test_isolation_forest_ignores_the_layout(spark):
    df = spark.createDataFrame([(i, float(i % 97), float(i * i % 31)) for i in range(3000)], "id int, a double, b double")
    found = [rows(anomaly.isolation_forest(df.repartition(n), ["a", "b"]).rows, "id", "is_anomaly") for n in (2, 7)]
    assert found[0] == found[1]
    same = spark.createDataFrame([(1.0, 2.0)] * 500, "a double, b double")
    assert anomaly.isolation_forest(same, ["a", "b"]).rows.count() == 500


def test_headers_are_read_in_one_pass(spark, tmp_path):
    def count(n):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"{i:03d}.csv").write_text("a,b\n1,2\n" if i % 2 == 0 else "x,y\n3,4\n")
        group = f"read-{n}"
        spark.sparkContext.setJobGroup(group, group)
        result = readers.read_delimited(spark, [str(folder)], schema="a int, b int")
        n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert result.rows.count() == (n + 1) // 2 and result.tables["skipped"].count() == n // 2
        return n_jobs

    assert count(4) == count(24)


def test_empty_input_gives_empty_results(spark):
    df = spark.createDataFrame([], "id int, a double, b double, g string, t double, e int")
    assert survival.kaplan_meier(df, "t", "e", "g").rows.count() == 0
    found = cluster.kmeans(df, ["a", "b"], k=3)
    assert found.rows.columns[-2:] == ["cluster_id", "cluster_distance"] and found.metrics.first()["rows_used"] == 0
    scored = anomaly.isolation_forest(df, ["a", "b"])
    assert scored.rows.columns[-2:] == ["is_anomaly", "anomaly_score"] and scored.metrics.first()["anomalies_detected"] == 0
    missing = spark.createDataFrame([(1, None, None), (2, None, 1.0)], "id int, a double, b double")
    assert cluster.kmeans(missing, ["a", "b"]).rows.filter("cluster_id IS NULL").count() == 2
    assert anomaly.isolation_forest(missing, ["a", "b"]).metrics.first()["rows_excluded"] == 2
    with pytest.raises(ValueError):
        cluster.kmeans(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"], k=3)

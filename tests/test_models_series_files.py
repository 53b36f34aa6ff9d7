"""Series, forests, anomalies, item responses, files, streams and user functions."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import ProfileResult
from statloom.functions.series import pelt, stl
from statloom.operators import anomaly, assessment, cluster, custom, forest, ledger
from statloom.operators import timeseries as ts
from statloom.sources import ingest, readers, writers
from statloom.streaming import jobs as streams
from tests.helpers import close, rows


def months(n, start="2015-01-01"):
    return pd.date_range(start, periods=n, freq="MS").strftime("%Y-%m-%d")


def test_frequencies_and_periods(spark):
    data = []
    for name, freq in (("d", "D"), ("w", "W"), ("m", "MS"), ("q", "QS"), ("y", "YS")):
        data += [(name, str(d.date())) for d in pd.date_range("2010-01-01", periods=12, freq=freq)]
    df = spark.createDataFrame([*data, ("one", "2020-01-01")], "s string, day string")
    assert dict(rows(ts.infer_frequency(df, "day", "s"), "series", "frequency")) == {"d": "D", "w": "W", "m": "MS", "q": "QS", "y": "YS", "one": "MS"}
    assert dict(rows(ts.infer_period(df, "day", "s"), "series", "period")) == {"d": 7, "w": 52, "m": 12, "q": 4, "y": 2, "one": 12}
    future = ts.future_dates(df, "day", 2, "s")
    got = {(r["series"], r["i"]): str(r["ds"])[:10] for r in future.collect()}
    for name, freq in (("d", "D"), ("w", "W"), ("m", "MS"), ("q", "QS"), ("y", "YS")):
        last = max(d for s, d in data if s == name)
        want = [str(d.date()) for d in pd.date_range(last, periods=4, freq=freq) if d > pd.Timestamp(last)][:2]
        assert [got[(name, 1)], got[(name, 2)]] == want, name


@pytest.mark.parametrize("size", [None, 6])
def test_fill_gaps(spark, size):
    rng = np.random.RandomState(1)
    v = pd.Series(rng.randn(40))
    v[rng.rand(40) < 0.4] = np.nan
    v[:3] = v[37:] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"i": range(40), "d": pd.date_range("2024-01-01", periods=40), "v": v}))
    for method, want in (("ffill", v.ffill().bfill()), ("linear", v.interpolate(limit_direction="both"))):
        got = ts.fill_gaps(df, "d", "v", "i", method=method, rows_per_bucket=size).rows.orderBy("i").toPandas()["filled_value"]
        assert np.allclose(got, want)


def test_change_points_of_two_regimes(spark):
    rng = np.random.RandomState(0)
    data = [(i, d, float(v), g) for g, (lo, hi) in {"a": (10, 20), "b": (5, 5)}.items() for i, (d, v) in enumerate(zip(months(40), np.r_[np.full(20, lo), np.full(20, hi)] + rng.randn(40) * 0.2))]
    df = spark.createDataFrame(data, "i int, d string, v double, g string")
    result = ts.change_points(df, "d", "v", "i", "g", model="l2")
    assert rows(result.tables["change_points"], "group", "position", "date") == [("a", 20, "2016-09-01 00:00:00")]
    seen = {r["i"]: (r["change_point"], r["segment_id"]) for r in result.rows.filter("g = 'a'").collect()}
    # the row of the break still belongs to the segment before it
    assert seen[19] == (False, 0) and seen[20] == (True, 0) and seen[21] == (False, 1)
    assert result.rows.count() == 80
    short = ts.change_points(df.filter("i < 4"), "d", "v", "i", "g")
    assert short.tables["change_points"].count() == 0


def test_change_points_in_pieces(spark):
    rng = np.random.RandomState(3)
    levels = np.repeat([0, 8, -4, 6, 1, 9], 60) + rng.randn(360)
    df = spark.createDataFrame(pd.DataFrame({"i": range(360), "d": pd.date_range("2020-01-01", periods=360), "v": levels}))
    whole = pelt(levels, "l2", 3, float(np.log(360) * levels.var()))
    pieces = ts.change_points(df, "d", "v", "i", model="l2", piece=120, rows_per_bucket=100).tables["change_points"]
    assert sorted(r["position"] for r in pieces.collect()) == whole == [60, 120, 180, 240, 300]


def test_decompose_in_pieces_equals_the_whole(spark):
    t = np.arange(600)
    rng = np.random.RandomState(2)
    y = 50 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 4) + rng.randn(600) * np.where(t < 300, 0.1, 2.0)
    y[::37] += 40  # outliers, against one scale for calm and wild parts
    made = {"a": y, "b": (t % 4).astype(float), "c": y[:90]}  # b leaves no residual, c is one piece
    frame = pd.concat([pd.DataFrame({"i": t[: len(v)], "d": pd.date_range("2020-01-01", periods=len(v)), "v": v, "g": g}) for g, v in made.items()])
    df = spark.createDataFrame(frame)
    got = ts.decompose(df, "d", "v", "i", "g", period=4, piece=150, rows_per_bucket=150).rows.orderBy("i").toPandas()
    for g, v in made.items():
        parts = got[got["g"] == g]
        for name, want in zip(("trend", "seasonal", "residual"), stl(v, 4)):
            assert np.allclose(parts[name], want, atol=1e-6), (g, name)


def test_decompose_short_and_missing(spark):
    df = spark.createDataFrame([(i, d, 1.0 + i) for i, d in enumerate(months(10))], "i int, d string, v double")
    result = ts.decompose(df, "d", "v", "i", period=12)
    assert result.rows.filter("trend is null").count() == 10
    gappy = spark.createDataFrame([(i, d, None if i == 7 else 10.0 + i % 4) for i, d in enumerate(months(24))], "i int, d string, v double")
    for model in ("additive", "multiplicative"):
        assert ts.decompose(gappy, "d", "v", "i", period=4, model=model).rows.filter("trend is not null").count() >= 20


def test_forecast_recovers_line_and_wave(spark):
    days = pd.date_range("2018-01-01", periods=1200)
    x = np.arange(1200)
    y = 100 + 0.05 * x + 8 * np.sin(2 * np.pi * x / 365.25) + 3 * np.cos(2 * np.pi * x / 7)
    pdf = pd.concat([pd.DataFrame({"d": days, "v": y, "g": "a"}), pd.DataFrame({"d": days, "v": np.exp(y / 100), "g": "b"})])
    result = ts.forecast(spark.createDataFrame(pdf), "d", "v", "g", 30)
    future = result.rows.filter("series = 'a' and is_forecast").orderBy("ds").toPandas()
    z = np.arange(1200, 1230)
    want = 100 + 0.05 * z + 8 * np.sin(2 * np.pi * z / 365.25) + 3 * np.cos(2 * np.pi * z / 7)
    assert len(future) == 30 and np.abs(future["yhat"] - want).max() < 1.0
    assert (future["yhat_lower"] <= future["yhat"]).all()
    wide = (future["yhat_upper"] - future["yhat_lower"]).to_numpy()
    assert (np.diff(wide) > 0).all()
    about = result.tables["series"].filter("series = 'a'").first()
    assert about["frequency"] == "D" and str(about["forecast_start"]) == "2021-04-15 00:00:00" and str(about["forecast_end"]) == "2021-05-14 00:00:00"
    only = ts.forecast(spark.createDataFrame(pdf), "d", "v", "g", 5, "multiplicative", include_history=False).rows
    assert only.count() == 10 and only.filter("yhat <= 0").count() == 0


def test_sums_of_a_series_go_on_over_batches():
    rng = np.random.RandomState(4)
    frame = pd.DataFrame({"series": ["a"] * 30 + ["b"] * 5 + ["c"] * 25, "t": rng.rand(60), "days": rng.rand(60) * 900, "yearly": 1.0, "weekly": 1.0})
    frame = frame.assign(y=rng.randn(60), n=1 + rng.randint(0, 3, 60), within=rng.rand(60))
    whole = pd.concat(ts._partial_sums([frame]))
    split = pd.concat(ts._partial_sums([frame[:12], frame[12:12], frame[12:33], frame[33:]]))
    assert list(split["series"]) == list(whole["series"]) == ["a", "b", "c"]
    assert np.allclose(np.stack(split["sums"]), np.stack(whole["sums"])) and np.allclose(split["n"], whole["n"])
    assert list(ts._partial_sums([])) == []


def test_forest_profiles(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(200), "x": rng.randn(200), "z": rng.randn(200)})
    pdf["grade"] = np.where(pdf.x > 0, "pass", "fail")
    pdf["y"] = pdf.x * 3
    pdf.loc[5, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    result = forest.random_forest(df, "grade", ["x", "z"], n_estimators=10, id_columns=["id"])
    assert result.metrics.first()["task"] == "classify" and result.metrics.first()["accuracy"] > 0.9
    row = result.rows.filter("id = 5").first()
    assert row["predicted_class"] is None and row["predicted_prob_pass"] is None
    assert result.rows.filter("abs(predicted_prob_pass + predicted_prob_fail - 1) < 1e-9").count() == 199
    assert result.tables["feature_importances"].first()["feature"] == "x"
    with pytest.raises(ValueError, match="task"):
        forest.random_forest(df.withColumn("w", F.col("id").cast("long")), "w", ["x", "z"])
    values = forest.random_forest(df, "y", ["x", "z"], n_estimators=10, id_columns=["id"])
    assert values.metrics.first()["task"] == "regress" and values.metrics.first()["r_squared"] > 0.8


def test_kmeans_separates_and_keeps_incomplete_rows(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"a": np.r_[rng.randn(30), rng.randn(30) + 50, np.nan], "b": np.r_[rng.randn(30), rng.randn(30) - 50, 1.0]})
    result = cluster.kmeans(spark.createDataFrame(pdf), ["a", "b"], k=2)
    assert rows(result.tables["cluster_sizes"], "n") == [(30,), (30,)]
    assert result.rows.filter("cluster_id is null and cluster_distance is null").count() == 1
    total = result.rows.agg(F.sum(F.col("cluster_distance") ** 2)).first()[0]
    assert close(total, result.metrics.first()["inertia"], 1e-6)
    with pytest.raises(ValueError):
        cluster.kmeans(spark.createDataFrame(pdf), ["a"], k=2)


@pytest.mark.parametrize("kind", ["Regressor", "Classifier"])
def test_forests_deal_a_table_of_one_part_to_many_tasks(spark, monkeypatch, kind):
    library, seen = getattr(forest, f"RandomForest{kind}"), []
    fit = library.fit
    monkeypatch.setattr(library, "fit", lambda self, data: (seen.append(data.rdd.getNumPartitions()), fit(self, data))[1])
    df = spark.range(0, 30_000, 1, 1).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 7 > 3, 5.0).otherwise(1.0).alias("y"))
    task = "regress" if kind == "Regressor" else "classify"
    result = forest.random_forest(df, "y", ["x"], n_estimators=3, max_depth=3, task=task, id_columns=["id"])
    column = "predicted_value" if kind == "Regressor" else "predicted_class"
    assert seen[0] >= 2 and result.rows.filter(F.col(column).cast("double") != F.col("y")).count() == 0


def test_kmeans_is_given_no_join_or_aggregate_below_its_cache(spark, monkeypatch):
    seen, fit = [], cluster.KMeans.fit
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, data: (seen.append(data._jdf.queryExecution().executedPlan().toString()), fit(self, data))[1])
    base = spark.range(40)
    joined = base.groupBy("id").agg(F.sum("id").cast("double").alias("a")).join(base.select("id", (F.col("id") % 2 * 90.0).alias("b")), "id")
    result = cluster.kmeans(joined, ["a", "b"], k=2)
    assert result.rows.filter("cluster_id is not null").count() == 40
    assert not any(word in seen[0] for word in ("Join", "Aggregate", "Exchange"))


def test_isolation_forest_flags_planted_rows(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(1000), "a": rng.randn(1000), "b": rng.randn(1000)})
    pdf.loc[:4, ["a", "b"]] = 30.0
    pdf.loc[999, "a"] = np.nan
    result = anomaly.isolation_forest(spark.createDataFrame(pdf), ["a", "b"], 0.02)
    flagged = {r["id"] for r in result.rows.filter("is_anomaly").collect()}
    assert set(range(5)) <= flagged and 15 <= len(flagged) <= 20
    assert result.rows.filter("id = 999").first()["is_anomaly"] is None
    assert result.rows.filter("anomaly_score < -1 or anomaly_score > 0").count() == 0
    plain = anomaly.isolation_forest(spark.createDataFrame(pdf), ["a", "b"], return_scores=False).rows
    assert "anomaly_score" not in plain.columns


def test_large_sample_path(spark):
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    drawn = anomaly._sampled(df.select(F.array("x", "y").alias("x")), 2_000_000, 100, 256, 1)
    sizes = drawn.groupBy("tree").count()
    assert drawn.count() < 1000 and sizes.agg(F.max("tree")).first()[0] < 100


def test_hypothesis_thresholds(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"a": np.r_[rng.randn(300), [60.0]], "k": ["x"] * 301})
    papers = spark.createDataFrame([("x", "an ARTIFACT of noise", ["s1", "s2", "s3", "s4", "s5", "s6"])], "k string, content string, sources array<string>")
    result = anomaly.anomaly_hypothesis(spark.createDataFrame(pdf), ["a"], "behavioral", literature=papers, literature_keys=["k"])
    row = result.rows.filter("a = 60").first()
    assert row["is_anomaly"] and row["anomaly_class"] == "known_noise" and row["supporting_citations"] == "s1; s2; s3; s4; s5; s6"
    assert result.metrics.first()["z_threshold"] == 2.5
    alone = anomaly.anomaly_hypothesis(spark.createDataFrame(pdf), ["a"]).rows.filter("is_anomaly").first()
    assert alone["anomaly_class"] == "novel_candidate" and alone["confidence"] == 0.5


def test_rounds_over_few_patterns_start_no_jobs(spark, monkeypatch):
    items = [f"i{j}" for j in range(5)]
    answers = [F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9)) < 3 + F.col("id") % 4, 1).otherwise(0).alias(i) for i in items]
    df = spark.range(2000).select("id", *answers)

    def fitted():
        return assessment.irt_2pl(df, items, "id", max_rounds=25)

    spark.sparkContext.setJobGroup("few patterns", "fit")
    try:
        few = fitted()
        started = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few patterns"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert few.metrics.first()["rounds"] > 15 > started
    monkeypatch.setattr(assessment, "FEW_PATTERNS", 4)
    for x, y in zip(few.tables["item_parameters"].collect(), fitted().tables["item_parameters"].collect()):
        assert np.allclose(x[1:], y[1:], rtol=1e-9)


def test_item_response_recovers_parameters(spark):
    rng = np.random.RandomState(0)
    theta = rng.randn(3000)
    a, b = [0.8, 1.2, 1.6, 1.0, 1.4, 2.0], [-1.0, -0.5, 0.0, 0.5, 1.0, 0.2]
    pdf = pd.DataFrame({f"item_{i}": (rng.rand(3000) < 1 / (1 + np.exp(-a[i] * (theta - b[i])))).astype(int) for i in range(6)})
    pdf["who"] = range(3000)
    result = assessment.irt_2pl(spark.createDataFrame(pdf), [f"item_{i}" for i in range(6)], "who")
    for r, x, y in zip(result.tables["item_parameters"].collect(), a, b):
        assert abs(r["discrimination"] - x) < 0.35 and abs(r["difficulty"] - y) < 0.25
        assert close(r["info_at_zero"], assessment.information(r["discrimination"], r["difficulty"], 0.0))
    found = result.tables["person_abilities"].orderBy("person_id").toPandas()
    assert np.corrcoef(found["theta"], theta)[0, 1] > 0.65 and (found["se"] > 0).all()
    assert result.tables["item_information"].count() == 42
    assert result.metrics.first()["converged"] is True
    # another prior is another scale: the same fit, moved and stretched
    moved = assessment.irt_2pl(spark.createDataFrame(pdf), [f"item_{i}" for i in range(6)], "who", ability_prior="normal(50, 10)")
    for r, m in zip(result.tables["item_parameters"].collect(), moved.tables["item_parameters"].collect()):
        assert close(m["difficulty"], 50 + 10 * r["difficulty"]) and close(m["discrimination"], r["discrimination"] / 10)
    there = moved.tables["person_abilities"].orderBy("person_id").toPandas()
    assert np.allclose(there["theta"], 50 + 10 * found["theta"]) and np.allclose(there["se"], 10 * found["se"])
    early = assessment.irt_2pl(spark.createDataFrame(pdf), [f"item_{i}" for i in range(6)], "who", max_rounds=1)
    assert tuple(early.metrics.first()) == (6, 1, False)
    with pytest.raises(ValueError):
        assessment.irt_2pl(spark.createDataFrame(pdf), ["item_0"])
    for prior in ("uniform(0,1)", "normal(0,0)", "normal(a,1)", "normal(0,-1)"):
        with pytest.raises(ValueError, match="ability_prior"):
            assessment.irt_2pl(spark.createDataFrame(pdf), [f"item_{i}" for i in range(6)], ability_prior=prior)


# --- files ------------------------------------------------------------------------------


def test_headers_decide_which_files_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("other,cols\n3,z\n")
    (tmp_path / "c.csv").write_bytes(b"id,name\n4,caf\xe9\n")
    result = readers.read_delimited(spark, [str(tmp_path)])
    assert result.rows.columns == ["id", "name"] and result.rows.count() == 3
    assert result.tables["skipped"].count() == 1
    tsv = tmp_path / "t.tsv"
    tsv.write_text("1\tx\n")
    assert rows(readers.read_delimited(spark, [str(tsv)], "\t", header=False).rows, "col_0", "col_1") == [(1, "x")]
    with pytest.raises(ValueError):
        readers.read_delimited(spark, [str(tsv)], "||")


def test_manifest_round_trip(spark, tmp_path):
    df = spark.range(10)
    df.write.parquet(str(tmp_path / "r.parquet"))
    writers.write_manifest(spark, str(tmp_path / "m"), [str(tmp_path / "r.parquet")])
    assert readers.read_manifest(spark, str(tmp_path / "m")).rows.count() == 10
    (tmp_path / "x.csv").write_text("k;v\n1;a\n")
    (tmp_path / "m.json").write_text(json.dumps({"fileLocations": [{"URIs": [str(tmp_path / "x.csv")]}], "globalUploadSettings": {"format": "CSV", "delimiter": ";", "containsHeader": "TRUE"}}))
    assert rows(readers.read_manifest(spark, str(tmp_path / "m.json")).rows, "k", "v") == [(1, "a")]
    (tmp_path / "bad.json").write_text(json.dumps({"fileLocations": [{"URIs": ["x"]}], "globalUploadSettings": {"format": "XLSX"}}))
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_manifest(spark, str(tmp_path / "bad.json"))


def test_result_metadata_and_export(spark, tmp_path):
    meta = writers.write_result(ProfileResult(spark.range(7)), str(tmp_path / "out"))
    assert meta["row_count"] == 7 and spark.read.parquet(str(tmp_path / "out/data.parquet")).count() == 7
    writers.export_csv(spark.range(100), str(tmp_path / "csv"), 10)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10


def test_geojson_geometries(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"id": 1, "name": "p"}, "geometry": {"type": "Point", "coordinates": [30, 10.5]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "properties": {"id": 4}, "geometry": {"type": "MultiPoint", "coordinates": [[0, 0], [1, 2]]}},
        {"type": "Feature", "properties": {"id": 5, "extra": 1.5}, "geometry": None},
    ]
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    result = ingest.ingest_geojson(spark, str(path), include_bbox=True)
    got = {r["id"]: r for r in result.rows.collect()}
    assert got[1]["geometry_wkt"] == "POINT (30 10.5)"
    assert got[2]["geometry_wkt"] == "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
    assert got[3]["geometry_wkt"] == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"
    assert got[4]["geometry_wkt"] == "MULTIPOINT ((0 0), (1 2))"
    assert got[5]["geometry_wkt"] is None and got[5]["extra"] == 1.5
    assert (got[3]["bbox_minx"], got[3]["bbox_maxy"]) == (0.0, 6.0)
    assert result.metrics.first()["n_null_geometries"] == 1
    shapes = ingest.read_polygons(spark, str(path))
    assert rows(shapes, "polygon_id", "polygon_label") == [(1, "polygon_1"), (2, "polygon_2")]
    (tmp_path / "bad.geojson").write_text(json.dumps({"type": "Topology"}))
    with pytest.raises(ValueError):
        ingest.ingest_geojson(spark, str(tmp_path / "bad.geojson"))


def test_pages_keep_their_numbers(spark):
    df = spark.createDataFrame([("x" * 60 + "\f" + "short" + "\f" + "y" * 50,)], "t string")
    result = ingest.ingest_pages(df, "t")
    assert rows(result.rows, "page_number", "char_count") == [(1, 60), (3, 50)]
    assert result.metrics.first()["avg_chars_per_page"] == 55.0
    with pytest.raises(ValueError):
        ingest.ingest_pages(df, "t", min_page_length=61)


def test_grid_flattening(spark):
    df = spark.createDataFrame([([10.0, 20.0], [1.0, 2.0, 3.0], [1.0, None, 3.0, 4.0, float("nan"), 6.0])], "lat array<double>, lon array<double>, t array<double>")
    result = ingest.ingest_grid(df, ["lat", "lon"])
    assert rows(result.rows) == [(10.0, 1.0, 1.0), (10.0, 3.0, 3.0), (20.0, 1.0, 4.0), (20.0, 3.0, 6.0)]
    assert tuple(result.metrics.first()) == (6, 4)
    with pytest.raises(ValueError, match="available"):
        ingest.ingest_grid(df, ["lat", "lon"], ["wind"])


# --- streams and user functions ---------------------------------------------------------


def test_stream_alerts_over_several_files(spark, tmp_path):
    data = [(i, f"u{i % 3}", 10.0 + i % 5, i * 3600) for i in range(60)]
    schema = "job_id int, user_id string, cost double, t int"
    all_jobs = spark.createDataFrame(data, schema).withColumn("started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz"))
    folder = tmp_path / "in"
    for part in range(3):  # files arrive in time order
        all_jobs.filter(f"job_id >= {part * 20} and job_id < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(str(folder))
        stream = streams.job_stream(spark, str(folder), all_jobs.schema, per_batch=1)
        streams.write_closed(streams.stream_budget_alerts(stream, 100.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ledger.budget_alerts(all_jobs, 100.0).rows
    assert rows(got, "user_id", "job_id", "spend_after") == rows(want, "user_id", "job_id", "spend_after")


def test_stream_alerts_of_a_hot_key_without_order(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else rng.choice(["a", None, "b"]), rng.choice([0.0, 0.25, 0.5, None]), rng.randrange(2_000_000)) for i in range(6000)]
    data += [(7000 + i, "tie", 60.0, 5) for i in range(4)] + [(8000, "late", 90.0, None), (8001, "late", 1.0, 3)]
    rng.shuffle(data)
    jobs = spark.createDataFrame(data, "job_id int, user_id string, cost double, t int").withColumn("started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz"))
    jobs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.job_stream(spark, str(tmp_path / "in"), jobs.schema)
    streams.write_closed(streams.stream_budget_alerts(stream, 100.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ledger.budget_alerts(jobs, 100.0).rows
    assert rows(got, "user_id", "job_id", "spend_after") == rows(want, "user_id", "job_id", "spend_after")
    assert got.count() >= 4


def test_stream_alerts_at_a_total_that_equals_the_mark(spark, tmp_path):
    data = [(i, "u", 0.1, i * 3600) for i in range(10)]  # eight times 0.1 is less than 0.8 in doubles
    jobs = spark.createDataFrame(data, "job_id int, user_id string, cost double, t int").withColumn("started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz"))
    for part in ("job_id < 3", "job_id >= 3"):
        jobs.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.job_stream(spark, str(tmp_path / "in"), jobs.schema, per_batch=1)
        streams.write_closed(streams.stream_budget_alerts(stream, 1.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "job_id", "spend_before", "spend_after") == [(7, 0.7, 0.8)]


def test_earliest_jobs_hold_few_rows_in_any_order():
    rng = random.Random(4)
    jobs = [(rng.randrange(50), i, rng.choice([0.5, 1.0, 2.0])) for i in range(20_000)]
    first, most = streams.Earliest(40.0), 0
    for job in jobs:
        first.add(job[:2], job[2])
        most = max(most, len(first.held))
    total = 0.0
    for at, name, cost in sorted(jobs):
        total += cost
        if total >= 40.0:
            break
    assert first.crossing() == ((at, name), total - cost, cost) and most <= 81


def test_incremental_runs_take_new_files_only(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    op = lambda df: df.agg(F.count("*").alias("n"))
    for n in (5, 7):
        spark.range(n).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.job_stream(spark, folder, spark.range(1).schema)
        streams.run_incremental(op, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0])
    assert seen == [5, 12]
    assert streams.run_incremental(op, stream, "", "", enabled=False) is None


def test_stream_metrics_count_a_job_once(spark, tmp_path):
    data = [(1, "p", 1.0, 10), (1, "p", 1.0, 20), (2, "p", 2.0, 30), (3, "q", 3.0, 200000)]
    jobs = spark.createDataFrame(data, "job_id int, profile_id string, cost double, t int").withColumn("duration_seconds", F.col("cost")).withColumn(
        "started_at", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))
    )
    jobs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.job_stream(spark, str(tmp_path / "in"), jobs.schema)
    streams.write_closed(streams.stream_job_metrics(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "profile_id", "cost", "jobs") == [("p", 3.0, 2)]


def test_user_functions(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "x int, g string")
    result = custom.custom_transform(df, lambda d: d.filter("x > 4"))
    assert tuple(result.metrics.first()) == (10, 5, 2)
    with pytest.raises(ValueError):
        custom.custom_transform(df, lambda d: 5)
    with pytest.raises(ValueError, match="too large"):
        custom.custom_grouped(df, ["g"], lambda p: p, "x int, g string", max_group_rows=3)

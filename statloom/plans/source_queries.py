"""Queries that write tables to files and read them back, and turn nested data into rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statloom.operators import geo
from statloom.plans.registry import query, rounded
from statloom.result import ProfileResult
from statloom.session import shared_folder
from statloom.sources import ingest, readers, writers


def scratch(t, name: str) -> str:
    """A new folder under the shared folder for one run of a query."""
    return f"{shared_folder(t.spark).rstrip('/')}/statloom-io/{name}-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("a1_read_csv", f"SELECT {CUSTOMER} FROM customer")
def _(t):
    path = scratch(t, "csv")
    t("customer").write.option("header", True).csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return readers.read_delimited(t.spark, [path], schema=schema).rows


@query("a1_read_tsv_without_header", "SELECT s_suppkey AS col_0, s_name AS col_1, s_nationkey AS col_2, s_acctbal AS col_3 FROM supplier")
def _(t):
    path = scratch(t, "tsv")
    t("supplier").write.option("sep", "\t").csv(path)
    rows = readers.read_delimited(t.spark, [path], "\t", header=False).rows
    return rows.withColumn("col_0", F.col("col_0").cast("long"))


@query("a1_skip_other_headers", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch(t, "mixed")
    t("customer").select("c_custkey", "c_name").write.option("header", True).csv(f"{path}/a")
    t("supplier").select("s_suppkey", "s_name").write.option("header", True).csv(f"{path}/b")
    return readers.read_delimited(t.spark, [f"{path}/a", f"{path}/b"], schema="c_custkey long, c_name string").rows


@query("a2_read_json_lines", f"SELECT {CUSTOMER} FROM customer")
def _(t):
    path = scratch(t, "json")
    t("customer").write.json(path)
    t("customer").select(F.concat(F.lit("{broken "), F.col("c_name")).alias("value")).write.mode("append").text(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return readers.read_json_lines(t.spark, [path], schema)


@query("a3_read_parquet", "SELECT * FROM orders")
def _(t):
    return readers.read_parquet(t.spark, [t.path("orders")])


@query("a4_read_manifest", f"SELECT {CUSTOMER} FROM customer")
def _(t):
    path = scratch(t, "manifest")
    halves = [t("customer").filter(F.col("c_custkey") % 2 == i) for i in (0, 1)]
    for i, half in enumerate(halves):
        half.write.parquet(f"{path}/part{i}.parquet")
    writers.write_manifest(t.spark, f"{path}/manifest", [f"{path}/part0.parquet", f"{path}/part1.parquet"])
    return readers.read_manifest(t.spark, f"{path}/manifest").rows


def point_features(t):
    lat = F.pmod(F.col("c_custkey") * 37, F.lit(180)) - 90 + 0.5
    lon = F.pmod(F.col("c_custkey") * 73, F.lit(360)) - 180 + 0.25
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
    )
    return t("customer").select(F.to_json(feature).alias("value"))


def band_polygons(t):
    """One longitude band per region, with the region key as file order."""
    k, width = F.col("r_regionkey"), F.lit(72.0)
    x0, x1 = F.lit(-180.0) + k * width, F.lit(-180.0) + (k + 1) * width
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(x0, -60), corner(x1, -60), corner(x1, 75), corner(x0, 75), corner(x0, -60))
    return t("region").select(k.alias("polygon_id"), F.col("r_name").alias("polygon_label"), F.array(ring).alias("rings"))


def nation_boxes(t):
    """Overlapping boxes, one per nation, each with a hole in the middle."""
    k = F.col("n_nationkey")
    x0, y0 = F.pmod(k * 53, F.lit(300)) - 160.0, F.pmod(k * 29, F.lit(120)) - 70.0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    square = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
    return t("nation").select(
        k.alias("polygon_id"), F.col("n_name").alias("polygon_label"), F.array(square(0.0, 40.0), square(15.0, 25.0)).alias("rings")
    )


def customer_points(t):
    return t("customer").select(
        "c_custkey",
        "c_acctbal",
        F.when(F.col("c_custkey") % 50 != 0, F.pmod(F.col("c_custkey") * 37, F.lit(180)) - 90 + 0.5).alias("lat"),
        (F.pmod(F.col("c_custkey") * 73, F.lit(360)) - 180 + 0.25).alias("lon"),
    )


@query("a5_geojson_points", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance,
  'POINT (' || regexp_replace(CAST((c_custkey * 73) % 360 - 180 + 0.25::DOUBLE AS VARCHAR), '\\.0$', '') || ' ' ||
  regexp_replace(CAST((c_custkey * 37) % 180 - 90 + 0.5::DOUBLE AS VARCHAR), '\\.0$', '') || ')' AS geometry_wkt FROM customer""")
def _(t):
    path = scratch(t, "geojson")
    point_features(t).write.text(path)
    return ingest.ingest_geojson(t.spark, path, lines=True).rows


@query("a5_geojson_polygons", """
SELECT 'NATION_' || k AS name, x AS bbox_minx, y AS bbox_miny, x + 40 AS bbox_maxx, y + 40 AS bbox_maxy FROM (
  SELECT n_nationkey AS k, ((n_nationkey * 53) % 300 - 160)::DOUBLE AS x, ((n_nationkey * 29) % 120 - 70)::DOUBLE AS y FROM nation)""")
def _(t):
    path = scratch(t, "collections")
    pairs = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("polygon_label").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")).alias("geometry"),
    )
    collections = (
        nation_boxes(t)
        .groupBy((F.col("polygon_id") % 5).alias("file"))
        .agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    )
    collections.select("value").write.text(path)
    rows = ingest.ingest_geojson(t.spark, path, include_bbox=True, lines=True).rows
    return rows.drop("geometry_wkt")


@query("a6_pages", """
SELECT doc_id, page_number, text, char_count FROM (
  SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS page_number, unnest(p) AS text, CAST(length(unnest(p)) AS INTEGER) AS char_count
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE char_count >= 50""")
def _(t):
    return ingest.ingest_pages(t("documents"), "text", "\n", 50, keep=["doc_id"]).rows


@query("a6_page_metrics", """
SELECT count(*) AS total_pages, count(*) FILTER (WHERE n >= 50) AS pages_extracted, count(*) FILTER (WHERE n < 50) AS pages_filtered,
       round(avg(n) FILTER (WHERE n >= 50), 1) AS avg_chars_per_page
FROM (SELECT length(unnest(string_split(text, chr(10)))) AS n FROM documents)""")
def _(t):
    return ingest.ingest_pages(t("documents"), "text", "\n", 50).metrics


@query("a7_grid", """
SELECT d AS depth, k AS cell, CASE WHEN (c_custkey * d + k) % 7 <> 0 THEN c_acctbal + d * 10 + k END AS temperature, (d * k)::DOUBLE AS salinity
FROM customer, (SELECT unnest([1, 2, 3]) AS d), (SELECT unnest([0, 1, 2, 3]) AS k)""")
def _(t):
    depth, cell = F.array(*[F.lit(i) for i in (1, 2, 3)]), F.array(*[F.lit(i) for i in (0, 1, 2, 3)])
    spots = F.flatten(F.transform("depth", lambda d: F.transform("cell", lambda k: F.struct(d.alias("d"), k.alias("k")))))
    grids = (
        t("customer")
        .withColumns({"depth": depth, "cell": cell})
        .withColumns(
            {
                "temperature": F.transform(
                    spots, lambda s: F.when((F.col("c_custkey") * s.d + s.k) % 7 != 0, F.col("c_acctbal") + s.d * 10 + s.k)
                ),
                "salinity": F.transform(spots, lambda s: (s.d * s.k).cast("double")),
            }
        )
        .select("depth", "cell", "temperature", "salinity")
    )
    return ingest.ingest_grid(grids, ["depth", "cell"]).rows


@query("b1_write_result", "SELECT count(*) AS row_count, CAST(5 AS INTEGER) AS column_count, count(DISTINCT c_custkey) AS keys_read FROM customer")
def _(t):
    path = scratch(t, "result")
    writers.write_result(ProfileResult(t("customer")), path)
    meta = t.spark.read.schema("row_count long, column_count int").json(f"{path}/metadata")
    data = t.spark.read.parquet(f"{path}/data.parquet").agg(F.count_distinct("c_custkey").alias("keys_read"))
    return meta.join(data)


@query("b2_export_csv", "SELECT count(*) AS exported FROM lineitem")
def _(t):
    path = scratch(t, "export")
    writers.export_csv(t("lineitem"), path)
    return t.spark.read.option("header", True).csv(path).agg(F.count("*").alias("exported"))


@query("b3_write_manifest", "SELECT 's3://results/' || o_orderkey || '.parquet' AS uri, 'PARQUET' AS format FROM orders")
def _(t):
    path = scratch(t, "listed")
    uris = t("orders").select(F.concat(F.lit("s3://results/"), F.col("o_orderkey").cast("string"), F.lit(".parquet")))
    writers.write_manifest(t.spark, path, uris)
    kind = "fileLocations array<struct<URIs:array<string>>>, globalUploadSettings struct<format:string>"
    loaded = t.spark.read.schema(kind).json(path).select(F.explode("fileLocations").alias("l"), F.col("globalUploadSettings.format").alias("format"))
    return loaded.select(F.explode("l.URIs").alias("uri"), "format")


@query("b4_append_audit", """
SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS profile_id, CAST(user_id AS VARCHAR) AS user_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS params,
  round(CASE WHEN event_type <> 'error' THEN value ELSE 1.5 END, 4) AS cost, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month FROM events""")
def _(t):
    path = scratch(t, "audit")
    jobs = t("events").select(
        F.col("event_id").alias("job_id"),
        F.col("event_type").alias("profile_id"),
        "user_id",
        F.from_json("props", "k int").alias("params"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("cost"),
        F.lit(1.5).alias("estimated_cost"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col("ts").alias("timestamp"),
    )
    writers.append_audit(jobs, path)
    back = t.spark.read.parquet(path)
    return rounded(back.select("job_id", "profile_id", "user_id", "params", "cost", "status", "year", "month"), 4)


@query("b5_latest_registered", """
WITH r AS (SELECT 'compute-result-' || (event_id % 500) AS source_id, 's3://r/' || event_id AS uri, event_type, user_id, ts FROM events)
SELECT source_id, arg_max(uri, ts) AS uri, arg_max(CAST(user_id AS VARCHAR), ts) AS created_by, [arg_max(event_type, ts), 'compute-result'] AS tags,
  'internal' AS data_classification FROM r GROUP BY 1""")
def _(t):
    jobs = t("events").select(
        (F.col("event_id") % 500).alias("job_id"),
        F.col("event_type").alias("profile_id"),
        "user_id",
        F.concat(F.lit("s3://r/"), F.col("event_id")).alias("result_uri"),
        F.col("ts").alias("registered_at"),
    )
    latest = writers.latest_registered(writers.register_results(jobs))
    return latest.select("source_id", "uri", "created_by", "tags", "data_classification")


# --- geography --------------------------------------------------------------------------

POINTS = """p AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 50 <> 0 THEN (c_custkey * 37) % 180 - 90 + 0.5::DOUBLE END AS lat,
  (c_custkey * 73) % 360 - 180 + 0.25::DOUBLE AS lon FROM customer)"""
HAV = "2 * 6371.0 * asin(sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2))"


@query("n1_haversine", f"WITH {POINTS} SELECT c_custkey, round({HAV.format(a='lat', b='40.0', c='lon', d='-75.0')}, 3) AS km FROM p")
def _(t):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0))
    return customer_points(t).select("c_custkey", F.round(km, 3).alias("km"))


BOXES = f"""WITH {POINTS}, b AS (SELECT n_nationkey AS k, n_name, (n_nationkey * 53) % 300 - 160.0 AS x, (n_nationkey * 29) % 120 - 70.0 AS y FROM nation),
h AS (SELECT c_custkey, min(k) AS k FROM p JOIN b ON lon > x AND lon < x + 40 AND lat > y AND lat < y + 40
  AND NOT (lon BETWEEN x + 15 AND x + 25 AND lat BETWEEN y + 15 AND y + 25) GROUP BY 1),
a AS (SELECT p.*, coalesce(k, -1) AS polygon_id, n_name AS polygon_label FROM p LEFT JOIN h USING (c_custkey) LEFT JOIN nation ON k = n_nationkey)"""


@query("n2_spatial_join", BOXES + " SELECT c_custkey, CAST(polygon_id AS INTEGER) AS polygon_id, polygon_label FROM a")
def _(t):
    rows = geo.spatial_aggregate(customer_points(t), "lat", "lon", nation_boxes(t)).rows
    return rows.select("c_custkey", "polygon_id", "polygon_label")


@query("n2_spatial_join_by_cells", BOXES + " SELECT c_custkey, CAST(polygon_id AS INTEGER) AS polygon_id, polygon_label FROM a")
def _(t):
    rows = geo.spatial_aggregate(customer_points(t), "lat", "lon", nation_boxes(t), broadcast_vertices=0).rows
    return rows.select("c_custkey", "polygon_id", "polygon_label")


@query("n3_polygon_summary", f"""WITH {POINTS}, a AS (SELECT *, CAST(floor((lon + 180) / 72) AS INTEGER) AS k FROM p WHERE lat > -60 AND lat < 75)
SELECT k AS polygon_id, r_name AS polygon_label, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal_mean, round(sum(c_acctbal), 4) AS c_acctbal_sum,
  min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, round(median(c_acctbal), 4) AS c_acctbal_median
FROM a JOIN region ON k = r_regionkey GROUP BY ALL""")
def _(t):
    every = ["count", "mean", "sum", "median", "min", "max"]
    return rounded(
        geo.spatial_aggregate(customer_points(t), "lat", "lon", band_polygons(t), ["c_acctbal"], every).tables["polygon_summary"], 4
    )


@query("n3_point_counts", BOXES + """
SELECT count(*) FILTER (WHERE lat IS NOT NULL) AS n_points_total, count(*) FILTER (WHERE polygon_id >= 0) AS n_points_assigned,
  count(*) FILTER (WHERE lat IS NOT NULL AND polygon_id < 0) AS n_points_unassigned, (SELECT count(*) FROM nation) AS n_polygons FROM a""")
def _(t):
    return geo.spatial_aggregate(customer_points(t), "lat", "lon", nation_boxes(t)).metrics


def _origins(t):
    return t("nation").select(
        (F.pmod(F.col("n_nationkey") * 11, F.lit(140)) - 70.0).alias("lat"),
        (F.pmod(F.col("n_nationkey") * 47, F.lit(350)) - 175.0).alias("lon"),
        F.col("n_name").alias("label"),
        F.col("n_nationkey").alias("position"),
    )


ISO = f"""WITH {POINTS}, o AS (SELECT (n_nationkey * 11) % 140 - 70.0::DOUBLE AS olat, (n_nationkey * 47) % 350 - 175.0::DOUBLE AS olon, n_name, n_nationkey AS k FROM nation),
d AS (SELECT c_custkey, n_name, k, {HAV.format(a='lat', b='olat', c='lon', d='olon')} AS km FROM p, o WHERE lat IS NOT NULL),
n AS (SELECT c_custkey, arg_min(n_name, (km, k)) AS nearest_origin, min(km) AS km FROM d GROUP BY 1),
r AS (SELECT p.c_custkey, nearest_origin, round(km, 3) AS distance_km, coalesce(km <= 800, false) AS within_catchment FROM p LEFT JOIN n USING (c_custkey))"""


@query("n4_isochrone", ISO + " SELECT * FROM r")
def _(t):
    return geo.isochrone(customer_points(t), "lat", "lon", _origins(t), 800.0, order_column="position").rows.drop("c_acctbal", "lat", "lon")


@query("n4_isochrone_by_cells", ISO + " SELECT * FROM r")
def _(t):
    rows = geo.isochrone(customer_points(t), "lat", "lon", _origins(t), 800.0, order_column="position", broadcast_origins=0).rows
    return rows.drop("c_acctbal", "lat", "lon")


@query("n5_catchment", ISO + """
SELECT count(*) AS n_records, count(nearest_origin) AS n_valid_coordinates, count(*) FILTER (WHERE within_catchment) AS n_within_catchment,
  round(count(*) FILTER (WHERE within_catchment) / count(nearest_origin), 4) AS pct_within_catchment FROM r""")
def _(t):
    return geo.isochrone(customer_points(t), "lat", "lon", _origins(t), 800.0, order_column="position").metrics


@query("n6_geo_enrich_zip", """
WITH z AS (SELECT c_custkey, lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') AS zip FROM customer),
t AS (SELECT 'T' || n_nationkey AS tract, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state, lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS county,
  CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 1000.0 END AS income FROM nation)
SELECT c_custkey, tract AS census_tract, state AS geo_state_fips, county AS geo_county_fips, income::DOUBLE AS median_income, NULL::DOUBLE AS unknown_variable
FROM z LEFT JOIN t ON zip <> '00000' AND tract = 'T' || CAST(CAST(zip AS INTEGER) AS VARCHAR)""")
def _(t):
    n = t("nation")
    tracts = n.select(
        F.concat(F.lit("T"), F.col("n_nationkey")).alias("census_tract"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("geo_state_fips"),
        F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("geo_county_fips"),
        F.when(F.col("n_nationkey") % 4 == 0, -1.0).otherwise(F.col("n_nationkey") * 1000.0).alias("median_income"),
    )
    zips = n.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip"), F.concat(F.lit("T"), F.col("n_nationkey")).alias("census_tract"))
    df = t("customer").select("c_custkey", (F.col("c_custkey") % 1000).cast("string").alias("zip_code"))
    return geo.geo_enrich(df, tracts, ["median_income", "unknown_variable"], "zip_code", zips).rows.drop("zip_code")


@query("n6_geo_enrich_points", BOXES + """
SELECT c_custkey, polygon_label AS census_tract, (n_nationkey * 1000)::DOUBLE AS median_income FROM a LEFT JOIN nation ON polygon_label = n_name""")
def _(t):
    tracts = t("nation").select(
        F.col("n_name").alias("census_tract"),
        F.col("n_nationkey").cast("string").alias("geo_state_fips"),
        F.col("n_regionkey").cast("string").alias("geo_county_fips"),
        (F.col("n_nationkey") * 1000.0).alias("median_income"),
    )
    rows = geo.geo_enrich(
        customer_points(t), tracts, ["median_income"], lat_column="lat", lon_column="lon", tract_polygons=nation_boxes(t)
    ).rows
    return rows.select("c_custkey", "census_tract", "median_income")

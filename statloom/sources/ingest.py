"""Turning feature collections, page texts and gridded arrays into rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.ordered import numbered
from statloom.result import ProfileResult, as_list, quoted, require_columns, require_rows
from statloom.session import cut_lineage

# Nesting depth of the coordinates of each geometry type (fixed values).
DEPTH = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}


def _coordinates(depth: int) -> Column:
    kind = "double"
    for _ in range(depth):
        kind = f"array<{kind}>"
    return F.from_json(F.get_json_object("geometry", "$.coordinates"), kind)


def _number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "\\.0$", "")


def _wkt_body(c: Column, depth: int, wrap_points: bool) -> Column:
    """Coordinates of the given depth as WKT text."""
    if depth == 1:
        return F.array_join(F.transform(c, _number_text), " ")
    inner = F.transform(
        c, lambda part: F.concat(F.lit("("), _wkt_body(part, depth - 1, False), F.lit(")"))
        if depth > 2 or wrap_points
        else _wkt_body(part, 1, False)
    )
    return F.array_join(inner, ", ")


def _positions(depth: int) -> Column:
    """All coordinate pairs of a geometry as one flat array."""
    c = _coordinates(depth)
    if depth == 1:
        return F.array(c)
    for _ in range(depth - 2):
        c = F.flatten(c)
    return c


def _pick(i: int):
    return lambda pair: F.element_at(pair, i)


def _by_type(make) -> Column:
    out = None
    for name, depth in DEPTH.items():
        cond = F.col("geometry_type") == name
        out = F.when(cond, make(name, depth)) if out is None else out.when(cond, make(name, depth))
    return out


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files as (feature_id, properties, geometry) texts.

    A file holds one FeatureCollection; with ``lines`` every line holds a
    FeatureCollection or a single Feature, and large files split across tasks.
    ``feature_id`` is the position in its collection, ``place`` sorts like the features
    stand in the files.
    """
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("doc"), where.alias("place"))
    doc = F.from_json("doc", "type string, crs string, features array<string>")
    parsed = text.filter(F.trim("doc") != "").withColumn("d", doc)
    features = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features"))
    if lines:
        features = features.when(F.col("d.type") == "Feature", F.array("doc"))
    one = F.from_json("feature", "properties string, geometry string")
    return (
        parsed.select(F.col("d.crs").alias("crs"), "place", F.posexplode(features).alias("feature_id", "feature"))
        .withColumn("f", one)
        .select("feature_id", F.struct("place.*", "feature_id").alias("place"), "crs", "f.properties", "f.geometry")
        .withColumn("geometry_type", F.get_json_object("geometry", "$.type"))
    )


def property_schema(features: DataFrame) -> str | None:
    """Merged type of all property objects, found in one aggregation."""
    found = features.agg(F.expr("schema_of_variant_agg(try_parse_json(properties))").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return None
    plain = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found)
    return plain.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING")


def ingest_geojson(
    spark: SparkSession,
    path: str,
    geometry_column: str = "geometry_wkt",
    include_bbox: bool = False,
    lines: bool = False,
    properties: str | None = None,
) -> ProfileResult:
    """One row per feature: every property a column, the geometry as WKT, optional bounds.

    ``properties`` (a struct type) saves the pass that infers the property types.
    """
    features = read_features(spark, path, lines)
    kind = properties or property_schema(features)
    if features.isEmpty():
        raise ValueError(f"no FeatureCollection with features at {path}")
    wkt = _by_type(
        lambda name, depth: F.concat(
            F.lit(name.upper() + " ("), _wkt_body(_coordinates(depth), depth, name == "MultiPoint"), F.lit(")")
        )
    )
    out = features.withColumn(geometry_column, wkt)
    bounds = []
    if include_bbox:
        xy = _by_type(lambda name, depth: _positions(depth))
        out = out.withColumn("_xy", xy)
        for axis, i in (("x", 1), ("y", 2)):
            values = F.transform("_xy", _pick(i))
            bounds += [F.array_min(values).alias(f"bbox_min{axis}"), F.array_max(values).alias(f"bbox_max{axis}")]
        bounds = [bounds[0], bounds[2], bounds[1], bounds[3]]
    named = [F.col("_p.*")] if kind else []
    if kind:
        out = out.withColumn("_p", F.from_json("properties", kind))
    rows = out.select(*named, *bounds, geometry_column)
    metrics = out.agg(
        F.count("*").alias("n_features"),
        F.array_sort(F.collect_set("geometry_type")).alias("geometry_types"),
        F.count_if(F.col(geometry_column).isNull()).alias("n_null_geometries"),
        F.max("crs").alias("crs"),
    )
    return ProfileResult(rows, {}, metrics)


def read_polygons(spark: SparkSession, path: str, label_property: str = "name", lines: bool = False) -> DataFrame:
    """Polygon features as (polygon_id, polygon_label, rings) for the spatial join.

    ``polygon_id`` numbers all features over files, lines and collections.
    """
    # written once: the places must not change between the numbering and the join
    every = cut_lineage(read_features(spark, path, lines))
    features = every.join(numbered(every, "place", "number"), "place").filter(F.col("geometry_type").isin("Polygon", "MultiPolygon"))
    rings = F.when(F.col("geometry_type") == "Polygon", _coordinates(3)).otherwise(F.flatten(_coordinates(4)))
    label = F.get_json_object("properties", f"$.{label_property}")
    return features.select(
        F.col("number").cast("int").alias("polygon_id"),
        F.coalesce(label, F.concat(F.lit("polygon_"), F.col("number"))).alias("polygon_label"),
        F.transform(
            rings, lambda r: F.transform(r, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
        ).alias("rings"),
    )


def ingest_pages(
    df: DataFrame,
    text_column: str,
    page_separator: str = "\f",
    min_page_length: int = 50,
    include_page_numbers: bool = True,
    keep: list[str] | None = None,
) -> ProfileResult:
    """One row per page of a document text; short pages drop out but count in the numbers.

    Where no page at all is long enough, that is an error.
    """
    require_columns(df, text_column=text_column)
    kept = [quoted(c) for c in as_list(keep)]
    pages = df.select(
        *kept,
        F.posexplode(F.split(F.col(quoted(text_column)), "\\Q" + page_separator + "\\E")).alias("_pos", "text"),
    ).withColumn("char_count", F.length("text"))
    long_enough = F.col("char_count") >= min_page_length
    rows = pages.filter(long_enough).withColumn("page_number", F.col("_pos") + 1)
    require_rows(rows, 1, f"pages of {min_page_length} or more characters")
    columns = [*kept, *(["page_number"] if include_page_numbers else []), "text", "char_count"]
    metrics = pages.agg(
        F.count("*").alias("total_pages"),
        F.count_if(long_enough).alias("pages_extracted"),
        F.count_if(~long_enough).alias("pages_filtered"),
        F.round(F.avg(F.when(long_enough, F.col("char_count"))), 1).alias("avg_chars_per_page"),
    )
    return ProfileResult(rows.select(*columns), {}, metrics)


def ingest_grid(df: DataFrame, dims: list[str], variables: list[str] | None = None) -> ProfileResult:
    """Flatten gridded arrays to one row per cell.

    Each input row holds one coordinate array per dimension and one value array per
    variable in row-major order. Cells where every variable is missing drop out.
    """
    dims = as_list(dims)
    require_columns(df, dims=dims)
    available = [c for c in df.columns if c not in dims]
    chosen = as_list(variables) or available
    missing = [v for v in chosen if v not in available]
    if missing:
        raise ValueError(f"variables not found: {missing}; available: {available}")
    cells = df.select(
        *[quoted(d) for d in dims], F.posexplode(F.arrays_zip(*[quoted(v) for v in chosen])).alias("_pos", "_cell")
    )
    coordinates = []
    stride = F.lit(1)
    for d in reversed(dims):
        size = F.size(quoted(d))
        index = F.pmod(F.floor(F.col("_pos") / stride).cast("int"), size)
        coordinates.insert(0, F.get(quoted(d), index).alias(d))
        stride = stride * size
    value = lambda v: F.col("_cell").getField(v)
    present = F.lit(False)
    for v in chosen:
        present = present | (value(v).isNotNull() & ~F.coalesce(F.isnan(value(v).cast("double")), F.lit(False)))
    flat = cells.select(*coordinates, *[value(v).alias(v) for v in chosen], present.alias("_present"))
    rows = flat.filter("_present").drop("_present")
    metrics = flat.agg(F.count("*").alias("rows_before"), F.count_if("_present").alias("rows_after"))
    return ProfileResult(rows, {}, metrics)

"""Distances, point-in-polygon joins, nearest origins and area enrichment.

Polygons come as a DataFrame with ``polygon_id`` (file order), ``polygon_label`` and
``rings``: an array of rings, each an array of points (x = longitude, y = latitude).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import number
from statloom.functions.ordered import exact_quantile
from statloom.functions.totals import attach_totals
from statloom.result import ProfileResult, as_list, quoted, require_columns
from statloom.session import cut_lineage

EARTH_RADIUS_KM = 6371.0
AGGREGATES = ("count", "mean", "sum", "median", "min", "max")
# Polygon sets and origin lists up to these sizes travel to every task; larger ones are joined.
BROADCAST_VERTICES = 200_000
BROADCAST_ORIGINS = 5_000
# First cell width of the nearest-origin search, on the unit sphere (about 6 km).
FIRST_CELL = 2.0**-10


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Polygons with their edges, bounding box, and grid level.

    The cell width of a level is the power of two at or above the larger side of the box,
    so a polygon covers at most four cells of its level.
    """
    closed = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    ring_edges = lambda ring: F.transform(
        F.sequence(F.lit(1), F.size(ring)),
        lambda i: F.struct(
            F.element_at(closed(ring), i).x.alias("x1"),
            F.element_at(closed(ring), i).y.alias("y1"),
            F.element_at(closed(ring), i + 1).x.alias("x2"),
            F.element_at(closed(ring), i + 1).y.alias("y2"),
        ),
    )
    xs, ys = F.transform("edges", lambda e: e.x1), F.transform("edges", lambda e: e.y1)
    boxed = (
        polygons.withColumn("edges", F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) > 0), ring_edges)))
        .filter(F.size("edges") > 0)
        .withColumns(
            {"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)}
        )
    )
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), F.lit(1e-6))
    return boxed.withColumn("level", F.ceil(F.log2(side)).cast("int")).drop("rings")


def _covered_cells(polygons: DataFrame) -> DataFrame:
    width = F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    return polygons.withColumn("cx", F.explode(span("x_min", "x_max"))).withColumn("cy", F.explode(span("y_min", "y_max")))


def inside_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Ray-crossing parity over all edges, so holes and multi-part shapes work.

    Points on the boundary are outside.
    """

    def crossing(e):
        spans = (e.y1 > y) != (e.y2 > y)
        at = (e.x2 - e.x1) * (y - e.y1) / F.when(e.y2 != e.y1, e.y2 - e.y1) + e.x1
        return spans & (x < at)

    def touches(e):
        cross = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
        within = x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
        return (cross == 0) & within

    odd = F.size(F.filter(edges, lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(edges, touches)


def _hits(x: Column, y: Column, p) -> Column:
    box = x.between(p["x_min"], p["x_max"]) & y.between(p["y_min"], p["y_max"])
    return box & inside_polygon(x, y, p["edges"])


def assign_polygons(
    df: DataFrame, lat_column: str, lon_column: str, polygons: DataFrame, broadcast_vertices: int = BROADCAST_VERTICES
) -> DataFrame:
    """Add ``polygon_id`` and ``polygon_label`` of the first polygon containing the point.

    Polygons are keyed by the grid cells they cover, one grid per size class. A set
    measured small is grouped by cell and sent to the points, which then stay where they
    are. A larger one is joined by cell to the distinct coordinates, and the smallest
    matching id per coordinate is joined back.
    """
    require_columns(df, lat_column=lat_column, lon_column=lon_column)
    shaped = cut_lineage(polygon_edges(polygons).withColumn("polygon_label", F.col("polygon_label").cast("string")))
    size = shaped.agg(F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("v"), F.collect_set("level").alias("levels")).first()
    levels = sorted(size["levels"])
    cells = _covered_cells(shaped)
    y, x = F.col("_y"), F.col("_x")
    points = df.withColumns({"_y": number(df, lat_column), "_x": number(df, lon_column)})
    at = lambda level: (
        F.floor(x / F.lit(2.0**level)).alias("cx"),
        F.floor(y / F.lit(2.0**level)).alias("cy"),
    )
    if size["v"] <= broadcast_vertices:
        found = []
        for level in levels:
            shape = F.struct("polygon_id", "polygon_label", "x_min", "x_max", "y_min", "y_max", "edges")
            grouped = (
                cells.filter(F.col("level") == level)
                .groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
                .agg(F.sort_array(F.collect_list(shape)).alias(f"_p{len(found)}"))
            )
            cx, cy = at(level)
            points = points.join(F.broadcast(grouped), (cx == F.col("_cx")) & (cy == F.col("_cy")), "left").drop("_cx", "_cy")
            match = F.get(F.filter(f"_p{len(found)}", lambda p: _hits(x, y, p)), F.lit(0))
            found.append(F.when(match.isNotNull(), F.struct(match.polygon_id.alias("id"), match.polygon_label.alias("label"))))
        nothing = F.lit(None).cast("struct<id:int,label:string>")
        best = nothing if not found else found[0] if len(found) == 1 else F.least(*found)
        out = points.withColumn("_hit", best)
    else:
        spots = points.select("_x", "_y").filter("_x is not null and _y is not null").distinct()
        keyed = spots.withColumn(
            "_k", F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *at(level)) for level in levels]))
        ).select("_x", "_y", "_k.*")
        hits = keyed.join(cells, ["level", "cx", "cy"]).filter(
            _hits(x, y, {c: F.col(c) for c in ("x_min", "x_max", "y_min", "y_max", "edges")})
        )
        first = hits.groupBy("_x", "_y").agg(F.min(F.struct(F.col("polygon_id").alias("id"), F.col("polygon_label").alias("label"))).alias("_hit"))
        out = points.join(first, ["_x", "_y"], "left")
    return out.select(
        *[quoted(c) for c in df.columns],
        F.coalesce(F.col("_hit.id"), F.lit(-1)).alias("polygon_id"),
        F.col("_hit.label").alias("polygon_label"),
    )


def spatial_aggregate(
    df: DataFrame,
    lat_column: str,
    lon_column: str,
    polygons: DataFrame,
    metric_columns: list[str] | None = None,
    agg_functions: list[str] = ("count", "mean"),
    broadcast_vertices: int = BROADCAST_VERTICES,
) -> ProfileResult:
    """Assign points to polygons and summarise metrics per polygon."""
    metrics, functions = as_list(metric_columns), as_list(agg_functions)
    bad = [a for a in functions if a not in AGGREGATES]
    if bad:
        raise ValueError(f"agg_functions must be among {AGGREGATES}, got {bad}")
    require_columns(df, columns=[lat_column, lon_column, *metrics])
    rows = assign_polygons(df, lat_column, lon_column, polygons, broadcast_vertices)
    assigned = rows.filter("polygon_id >= 0")
    keys = ["polygon_id", "polygon_label"]
    simple = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    aggs = [F.count("*").alias("n")]
    aggs += [simple[a](number(df, m)).alias(f"{m}_{a}") for m in metrics for a in functions if a in simple]
    summary = assigned.groupBy(*keys).agg(*aggs)
    if "median" in functions:
        for m in metrics:
            values = assigned.select(*keys, number(df, m).alias("_v"))
            summary = summary.join(exact_quantile(values, "_v", keys, 0.5, f"{m}_median"), keys, "left")
    valid = number(df, lat_column).isNotNull() & number(df, lon_column).isNotNull()
    counts = rows.agg(
        F.count_if(valid).alias("n_points_total"),
        F.count_if(F.col("polygon_id") >= 0).alias("n_points_assigned"),
        F.count_if(valid & (F.col("polygon_id") < 0)).alias("n_points_unassigned"),
    )
    n_polygons = polygons.agg(F.count("*").alias("n_polygons"))
    return ProfileResult(rows, {"polygon_summary": summary}, attach_totals(counts, n_polygons))


def _unit_vector(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _nearest_by_cells(spots: DataFrame, origins: DataFrame) -> DataFrame:
    """Nearest origin per coordinate by cells on the unit sphere that double every round.

    An origin within one cell width of a point lies in one of the 27 cells around it, so
    a nearest candidate within that chord length is final; the other points go on with
    wider cells until all are settled.
    """
    placed = cut_lineage(
        origins.select("_olat", "_olon", "_olabel", "_order", *[c.alias(n) for n, c in zip("abc", _unit_vector(F.col("_olat"), F.col("_olon")))])
    )
    open_spots = cut_lineage(
        spots.select("_y", "_x", *[c.alias(n) for n, c in zip(("pa", "pb", "pc"), _unit_vector(F.col("_y"), F.col("_x")))])
    )
    width, settled = FIRST_CELL, []
    while True:
        last = width >= 4.0
        cell = lambda c: F.floor(F.col(c) / F.lit(width))  # noqa: E731, B023
        around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = placed
        for n in "abc":
            near = near.withColumn(f"d{n}", F.explode(around)).withColumn(f"k{n}", cell(n) + F.col(f"d{n}")).drop(f"d{n}")
        keyed = open_spots.withColumns({f"k{n}": cell(f"p{n}") for n in "abc"})
        distance = haversine_km(F.col("_y"), F.col("_x"), F.col("_olat"), F.col("_olon"))
        best = (
            keyed.join(near, ["ka", "kb", "kc"])
            .groupBy("_y", "_x")
            .agg(F.min(F.struct(distance.alias("d"), F.col("_order"), F.col("_olabel"))).alias("best"))
        )
        # the chord that a distance spans; a little slack covers rounding
        chord = 2 * F.sin(F.col("best.d") / (2 * EARTH_RADIUS_KM))
        final = best if last else best.filter(chord <= width * (1 - 1e-9))
        done = cut_lineage(final)
        settled.append(done)
        if last:
            break
        open_spots = cut_lineage(open_spots.join(done.select("_y", "_x"), ["_y", "_x"], "left_anti"))
        if open_spots.isEmpty():
            break
        width *= 4.0
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def isochrone(
    df: DataFrame,
    lat_column: str,
    lon_column: str,
    origins: DataFrame,
    max_distance_km: float = 80.0,
    label_column: str = "label",
    order_column: str | None = None,
    broadcast_origins: int = BROADCAST_ORIGINS,
) -> ProfileResult:
    """Nearest origin by great-circle distance and whether it is within reach.

    ``order_column`` decides ties (label by default). Origins without both coordinates
    are no origins; ``tables["origins"]`` counts them. Origins counted as few are tried
    on every row; many origins are searched through cells on the sphere.
    """
    require_columns(df, lat_column=lat_column, lon_column=lon_column)
    require_columns(origins, columns=["lat", "lon", label_column])
    listed = origins.select(
        number(origins, "lat").alias("_olat"),
        number(origins, "lon").alias("_olon"),
        F.col(quoted(label_column)).cast("string").alias("_olabel"),
        F.col(quoted(order_column or label_column)).alias("_order"),
    )
    listed = listed.filter("_olat IS NOT NULL AND _olon IS NOT NULL")
    points = df.withColumns({"_y": number(df, lat_column), "_x": number(df, lon_column)})
    valid = F.col("_y").isNotNull() & F.col("_x").isNotNull()
    n_origins = listed.limit(broadcast_origins + 1).count()
    if n_origins <= broadcast_origins:
        every = listed.agg(F.sort_array(F.collect_list(F.struct("_order", "_olat", "_olon", "_olabel"))).alias("_all"))
        joined = attach_totals(points, every)
        candidates = F.transform(
            "_all",
            lambda o: F.struct(
                haversine_km(F.col("_y"), F.col("_x"), o["_olat"], o["_olon"]).alias("d"), o["_order"].alias("_order"), o["_olabel"].alias("_olabel")
            ),
        )
        out = joined.withColumn("best", F.when(valid, F.array_min(candidates)))
    else:
        spots = points.filter(valid).select("_y", "_x").distinct()
        out = points.join(_nearest_by_cells(spots, listed), ["_y", "_x"], "left")
    within = F.coalesce(F.col("best.d") <= F.lit(float(max_distance_km)), F.lit(False))
    rows = out.select(
        *[quoted(c) for c in df.columns],
        F.col("best._olabel").alias("nearest_origin"),
        F.round("best.d", 3).alias("distance_km"),
        within.alias("within_catchment"),
    )
    metrics = rows.agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("nearest_origin").isNotNull()).alias("n_valid_coordinates"),
        F.count_if("within_catchment").alias("n_within_catchment"),
    ).withColumn(
        "pct_within_catchment",
        F.coalesce(F.round(F.try_divide("n_within_catchment", "n_valid_coordinates"), 4), F.lit(0.0)),
    )
    n_listed = origins.agg(F.count("*").alias("n_origins"), F.count_if(number(origins, "lat").isNull() | number(origins, "lon").isNull()).alias("n_origins_dropped"))
    return ProfileResult(rows, {"origins": n_listed}, metrics)


def geo_enrich(
    df: DataFrame,
    tract_table: DataFrame,
    variables: list[str],
    zip_column: str | None = None,
    zip_table: DataFrame | None = None,
    lat_column: str | None = None,
    lon_column: str | None = None,
    tract_polygons: DataFrame | None = None,
) -> ProfileResult:
    """Add tract, state, county and requested variables from reference tables.

    By ZIP code: ``zip_table`` maps ``zip`` to ``census_tract``. By coordinates: the first
    polygon whose label is the tract. ``tract_table`` holds ``census_tract``,
    ``geo_state_fips``, ``geo_county_fips`` and variables; unknown variable names come
    back as NULL, negative values too.
    """
    variables = as_list(variables)
    if lat_column and lon_column:
        if tract_polygons is None:
            raise ValueError("tract_polygons is required with coordinates")
        placed = assign_polygons(df, lat_column, lon_column, tract_polygons)
        located = placed.withColumnRenamed("polygon_label", "_tract").drop("polygon_id")
    elif zip_column:
        if zip_table is None:
            raise ValueError("zip_table is required with zip_column")
        require_columns(df, zip_column=zip_column)
        text = F.lpad(F.trim(F.col(quoted(zip_column)).cast("string")), 5, "0")
        code = F.when((F.trim(F.col(quoted(zip_column)).cast("string")) != "") & (text != "00000"), text)
        places = zip_table.select(F.col("zip").alias("_zip"), F.col("census_tract").alias("_tract"))
        located = df.withColumn("_zip", code).join(places, "_zip", "left").drop("_zip")
    else:
        raise ValueError("either lat_column and lon_column, or zip_column, is required")
    have = [v for v in variables if v in tract_table.columns]
    facts = tract_table.select(
        F.col("census_tract").alias("_tract"),
        "geo_state_fips",
        "geo_county_fips",
        *[F.when(number(tract_table, v) >= 0, number(tract_table, v)).alias(v) for v in have],
    )
    joined = located.join(facts.withColumn("_known", F.lit(True)), "_tract", "left")
    known = F.col("_known").isNotNull()
    rows = joined.select(
        *[quoted(c) for c in df.columns],
        F.when(known, F.col("_tract")).alias("census_tract"),
        "geo_state_fips",
        "geo_county_fips",
        *[F.col(quoted(v)) if v in have else F.lit(None).cast("double").alias(v) for v in variables],
    )
    metrics = rows.agg(
        F.count_if(F.col("census_tract").isNotNull()).alias("rows_enriched"),
        F.count_if(F.col("census_tract").isNull()).alias("rows_skipped"),
    )
    return ProfileResult(rows, {}, metrics)

"""k-means clustering on scaled complete rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import all_present, number
from statloom.result import ProfileResult, as_list, numeric_features, require_columns, require_count
from statloom.session import cut_lineage


def scaled_columns(df: DataFrame, features: list[str], standardize: bool = True) -> tuple[int, list[Column]]:
    """Complete row count and the features as z-scores (population deviation)."""
    present = all_present(df, features)
    stats = df.filter(present).agg(
        F.count("*").alias("n"),
        *[F.avg(number(df, f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(number(df, f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    if not standardize:
        return stats["n"], [number(df, f) for f in features]
    return stats["n"], [
        (number(df, f) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, f in enumerate(features)
    ]


# Differences written out one by one at most.
UNROLLED = 128


def assign_centers(df: DataFrame, xs: list[Column], centers: list[list[float]], present: Column) -> DataFrame:
    """Add the nearest centre (first wins ties) and the Euclidean distance to it.

    Centres are literals in the expression, so scoring is one projection without a join.
    """
    def square(x: Column, c: Column) -> Column:
        return (x - c) * (x - c)

    if len(xs) * len(centers) <= UNROLLED:
        squares = [
            F.struct(sum((square(x, F.lit(float(c))) for x, c in zip(xs, center)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"))
            for i, center in enumerate(centers)
        ]
        best = squares[0] if len(squares) == 1 else F.least(*squares)
    else:
        # the same sums as array expressions: unrolled they would outgrow compiled code
        listed = F.array(*[F.array(*[F.lit(float(c)) for c in center]) for center in centers])
        total = lambda c: F.aggregate(F.zip_with(F.array(*xs), c, square), F.lit(0.0), lambda a, b: a + b)
        best = F.array_min(F.transform(listed, lambda c, i: F.struct(total(c).alias("d"), i.alias("i"))))
    return (
        df.withColumn("_best", F.when(present, best))
        .withColumns({"cluster_id": F.col("_best.i"), "cluster_distance": F.sqrt("_best.d")})
        .drop("_best")
    )


def kmeans(
    df: DataFrame, features: list[str] | None = None, k: int = 5, standardize: bool = True, seed: int = 42, max_iter: int = 300
) -> ProfileResult:
    """Cluster id and distance per row; incomplete rows keep NULLs.

    Rounds go on until the centres stay; ``converged`` is false where ``max_iter`` ended them.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    features = as_list(features) or numeric_features(df)
    require_columns(df, features=features)
    if len(features) < 2:
        raise ValueError("k-means requires at least 2 numeric feature columns")
    n, xs = scaled_columns(df, features, standardize)
    spark = df.sparkSession
    if not n:
        return _no_clusters(df, k, standardize)
    require_count(n, k, f"{k} clusters")
    present = all_present(df, features)
    names = [f"_x{i}" for i in range(len(xs))]
    # The library caches what it is given; sorts of a join or aggregate below the cache would
    # compete with it for memory in one task, so it gets a written copy of the features.
    copy = cut_lineage(df.filter(present).select([x.alias(c) for c, x in zip(names, xs)]))
    data = VectorAssembler(inputCols=names, outputCol="_v").transform(copy)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="_p").fit(data.select("_v"))
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    rows = assign_centers(df, xs, centers, present)
    summary = model.summary
    tables = {
        "centers": spark.createDataFrame(
            [(i, f, v) for i, c in enumerate(centers) for f, v in zip(features, c)],
            "cluster_id int, feature string, value double",
        ),
        "cluster_sizes": rows.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")),
    }
    metrics = spark.createDataFrame(
        [(k, standardize, float(summary.trainingCost), int(summary.numIter), n, summary.numIter < max_iter)],
        "k int, standardized boolean, inertia double, n_iter int, rows_used long, converged boolean",
    )
    return ProfileResult(rows, tables, metrics)


def _no_clusters(df: DataFrame, k: int, standardize: bool) -> ProfileResult:
    """The result without a complete row: the same columns, no cluster."""
    rows = df.withColumns({"cluster_id": F.lit(None).cast("int"), "cluster_distance": F.lit(None).cast("double")})
    spark = df.sparkSession
    tables = {
        "centers": spark.createDataFrame([], "cluster_id int, feature string, value double"),
        "cluster_sizes": spark.createDataFrame([], "cluster_id int, n long"),
    }
    schema = "k int, standardized boolean, inertia double, n_iter int, rows_used long, converged boolean"
    return ProfileResult(rows, tables, spark.createDataFrame([(k, standardize, 0.0, 0, 0, True)], schema))


def kmeans_assign(
    df: DataFrame, features: list[str], centers: list[list[float]], standardize: bool = True
) -> ProfileResult:
    """Assign rows to given centres (in scaled space when ``standardize``)."""
    require_columns(df, features=features)
    _, xs = scaled_columns(df, features, standardize)
    rows = assign_centers(df, xs, centers, all_present(df, features))
    metrics = rows.agg(F.sum(F.col("cluster_distance") * F.col("cluster_distance")).alias("inertia"))
    sizes = rows.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return ProfileResult(rows, {"cluster_sizes": sizes}, metrics)

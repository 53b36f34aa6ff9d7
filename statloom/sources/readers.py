"""Reading delimited text, JSON lines, Parquet and manifests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.result import ProfileResult, as_list
from statloom.session import cut_lineage

FORMATS = ("CSV", "TSV", "JSON", "PARQUET")


def list_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files under the paths, by name; only the listing is read."""
    found = spark.read.format("binaryFile").load(as_list(paths)).select("path").orderBy("path")
    return [r["path"] for r in found.collect()]


def _first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, header): the first line of every file that has one, in one pass over all of them."""
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")]
    lines = spark.read.text(paths).select("value", *where).filter("at = 0")
    # numbers grow along a file's first block
    return cut_lineage(lines.groupBy("path").agg(F.min_by("value", "n").alias("header")))


def read_delimited(
    spark: SparkSession,
    paths: list[str],
    delimiter: str = ",",
    header: bool = True,
    schema: str | None = None,
    infer: bool = True,
) -> ProfileResult:
    """CSV or TSV files with the header of the first file.

    Files with another header are left out and listed in ``tables["skipped"]``. Without a
    header the columns are ``col_0``, ``col_1``, …. A schema saves the inference pass.
    """
    paths = as_list(paths)
    if not isinstance(delimiter, str) or len(delimiter) != 1:
        raise ValueError(f"a delimiter is one character, not {delimiter!r}")
    reader = spark.read.option("sep", delimiter).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    skipped = spark.createDataFrame([], "path string, header string")
    if header:
        heads = _first_lines(spark, paths)
        first = heads.orderBy("path").first()
        if first is None:
            raise ValueError("source files are empty")
        same = F.col("header") == F.lit(first["header"])
        skipped = heads.filter(~same)
        if not skipped.isEmpty():
            paths = [r["path"] for r in heads.filter(same).select("path").orderBy("path").collect()]
        reader = reader.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    df = reader.csv(paths)
    if not header and not schema:
        df = df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    return ProfileResult(df, {"skipped": skipped})


def read_json_lines(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """One JSON object per line; broken lines are dropped, missing fields stay NULL."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(as_list(paths))


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*as_list(paths))


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by the file name."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return read_parquet(spark, [path])
    if ending in ("json", "jsonl", "ndjson"):
        return read_json_lines(spark, [path])
    return read_delimited(spark, [path], "\t" if ending in ("tsv", "tab") else ",").rows


def read_manifest(spark: SparkSession, path: str) -> ProfileResult:
    """All files named by a manifest: URIs, prefixes, format, delimiter and header flag."""
    manifest = spark.read.schema(
        "fileLocations array<struct<URIs:array<string>,URIPrefixes:array<string>>>, "
        "globalUploadSettings struct<format:string,delimiter:string,containsHeader:string>"
    ).option("multiLine", True).json(path)
    located = manifest.select(
        F.explode("fileLocations").alias("loc"), F.col("globalUploadSettings").alias("s")
    ).select(
        F.explode(F.concat(*[F.coalesce(f"loc.{c}", F.array().cast("array<string>")) for c in ("URIs", "URIPrefixes")])).alias("uri"),
        "s",
    )
    rows = located.select("uri", "s.format", "s.delimiter", "s.containsHeader").collect()
    if not rows:
        raise ValueError("manifest contains no file URIs")
    kind = (rows[0]["format"] or "CSV").upper()
    delimiter = rows[0]["delimiter"] or ("\t" if kind == "TSV" else ",")
    if len(delimiter) != 1:
        raise ValueError(f"a delimiter is one character, not {delimiter!r}")
    has_header = (rows[0]["containsHeader"] or "TRUE").upper() == "TRUE"
    uris = [r["uri"] for r in rows]
    if kind in ("CSV", "TSV"):
        return read_delimited(spark, uris, delimiter, has_header)
    if kind == "JSON":
        return ProfileResult(read_json_lines(spark, uris))
    if kind == "PARQUET":
        return ProfileResult(spark.read.option("mergeSchema", True).parquet(*uris))
    raise ValueError(f"unsupported manifest file format: {kind}; supported formats: {FORMATS}")

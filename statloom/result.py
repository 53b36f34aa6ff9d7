"""The result type shared by all operators and the requirement checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class ProfileResult:
    """Result rows, named extra tables and (usually one-row) metrics."""

    rows: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    metrics: DataFrame | None = None


# Column type tags a requirement may name (fixed values).
TYPE_TAGS = {
    "numeric": (T.NumericType,),
    "integer": (T.IntegralType,),
    "string": (T.StringType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType),
}


def as_list(value) -> list:
    if value is None or value == "":
        return []
    return [value] if isinstance(value, str) else list(value)


def require_columns(df: DataFrame, **params) -> None:
    """Each keyword is a parameter name with one column name or a list of them."""
    for name, value in params.items():
        cols = as_list(value)
        if not cols:
            raise ValueError(f"parameter '{name}' is required")
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"{name}: columns not found: {missing}")


def require_rows(df: DataFrame, minimum: int, what: str) -> None:
    """Check a minimum row count without counting the whole input."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"too few rows ({found}) for {what}; at least {minimum} needed")


def require_count(found: int, minimum: int, what: str) -> None:
    if found < minimum:
        raise ValueError(f"too few rows ({found}) for {what}; at least {minimum} needed")


def check_requirements(
    df: DataFrame,
    params: dict,
    column_params: list[str] = (),
    optional: list[str] = (),
    column_types: dict[str, str] | None = None,
    min_rows: int = 0,
) -> dict:
    """Check that the columns named by parameters exist and have the declared type.

    Absent optional parameters are skipped. Types are read from the schema; only the
    minimum-row check runs a job, and that one stops at ``min_rows`` rows.
    """
    checked = []
    for name in column_params:
        cols = as_list(params.get(name))
        if not cols:
            if name in optional:
                continue
            raise ValueError(f"parameter '{name}' is required")
        require_columns(df, **{name: cols})
        tag = (column_types or {}).get(name)
        if tag:
            bad = [c for c in cols if not isinstance(df.schema[c].dataType, TYPE_TAGS[tag])]
            if bad:
                raise ValueError(f"{name}: columns {bad} are not of type {tag}")
        checked += cols
    if min_rows:
        require_rows(df, min_rows, "this profile")
    return {"columns_checked": checked, "min_rows": min_rows}


def numeric_features(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Numeric columns in schema order, without the excluded ones."""
    drop = set(as_list(exclude))
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([tuple(values)], schema)


def quoted(name: str) -> str:
    """Backquote a column name so that dots or blanks in it survive."""
    return "`" + name.replace("`", "``") + "`"

"""Running a function over whole texts, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], schema: str, rows_per_batch: int = 4096, slice_rows: int | None = None) -> DataFrame:
    """Apply ``fn(columns) -> rows`` to every Arrow batch of ``df``.

    ``columns`` maps each column name to its Python values; the rows follow ``schema``, a
    DDL string. The function runs once per batch, so what it keeps ends with the batch, or
    once per ``slice_rows`` rows of it, which holds fewer values at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = slice_rows or max(batch.num_rows, 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                yield from in_batches(fn(columns), target, rows_per_batch)

    return df.mapInArrow(run, schema)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)

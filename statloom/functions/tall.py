"""Least squares on tall tables of any width by QR factors of their parts.

Every task folds its rows, one Arrow batch after the other, into the triangular factor of
what it has read; factors are merged in groups, streamed one at a time, and the last few
on the driver. A factor has (columns)² numbers whatever the rows. Unlike sums of products,
factors keep the digits of nearly dependent columns; dependent ones are found by singular
values and share their effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 32  # groups in which factors are merged before the driver takes them
RANK_TOLERANCE = 1e-10
_SCHEMA = "part int, r binary, totals binary"

#: From the values of a batch, (rows, columns): the rows to factor, and numbers to add up.
Step = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def triangular(df: DataFrame, columns: list[Column], step: Step) -> tuple[np.ndarray, np.ndarray]:
    """The factor R of the rows that ``step`` makes of the columns, and the totals it adds up.

    Without rows both are empty.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = totals = None
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rows, numbers = step(values)
                r, totals = _stacked(r, rows), numbers if totals is None else totals + numbers
        if r is not None:
            yield _row(TaskContext.get().partitionId() if TaskContext.get() else 0, r, totals)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(int(key[0].as_py()), *_merged((r, t) for batch in batches for r, t in zip(batch.column("r").to_pylist(), batch.column("totals").to_pylist())))

    parts = df.select(F.array(*[c.cast("double") for c in columns]).alias("x")).mapInArrow(fold, _SCHEMA)
    found = parts.groupBy(F.pmod("part", F.lit(FAN_IN)).alias("group")).applyInArrow(merge, _SCHEMA).orderBy("part").collect()
    return _merged((row["r"], row["totals"]) for row in found)


def _stacked(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _row(part: int, r: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    padded = np.zeros((r.shape[1], r.shape[1]))
    padded[: len(r)] = r
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([padded.tobytes()]), pa.array([totals.astype(float).tobytes()])], ["part", "r", "totals"])


def _merged(pieces) -> tuple[np.ndarray, np.ndarray]:
    r, totals = None, None
    for factor, numbers in pieces:
        one, added = np.frombuffer(factor), np.frombuffer(numbers)
        side = round(len(one) ** 0.5)
        r, totals = _stacked(r, one.reshape(side, side)), added if totals is None else totals + added
    return (np.zeros((0, 0)), np.zeros(0)) if r is None else (r, totals)


def solve(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, (X'X)⁻¹, and sums of squared residuals and fitted values from the factor of [X, y].

    Columns are brought to equal length first; directions that are shorter than
    ``RANK_TOLERANCE`` of the longest count as dependent and are left out.
    """
    k = r.shape[1] - 1
    x, y = r[:, :k], r[:, k]
    length = np.sqrt((x * x).sum(axis=0))
    length[length == 0] = 1.0
    u, s, vt = np.linalg.svd(x / length, full_matrices=False)
    kept = s > RANK_TOLERANCE * s.max(initial=0.0)
    u, s, vt = u[:, kept], s[kept], vt[kept]
    half = vt.T / s
    fitted = u.T @ y
    rest = y - u @ fitted
    return half @ fitted / length, (half @ half.T) / np.outer(length, length), float(rest @ rest), float(fitted @ fitted)

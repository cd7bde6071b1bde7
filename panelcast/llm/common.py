"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: other columns cannot clash with an operator's own."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have yet, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def kind(df: DataFrame, column: str = "id") -> str:
    """Type of a column as a word of a schema string."""
    return df.schema[column].dataType.simpleString()


def whole(column) -> pa.Array:
    """A column of a batch or table as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int):
    """Slices of at most ``rows`` rows and, unless one row has more, ``size`` bytes of a text or entries of a list."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_nested(values.type) else pc.binary_length(values)
    until = np.cumsum(sizes.fill_null(0), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(until, size + (until[at - 1] if at else 0), "right"))
        n = min(rows, max(1, most - at))
        yield batch.slice(at, n)
        at += n


def vectors(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``width`` numbers, mask of the usable rows): null, wrong-sized, zero or non-finite rows are not usable."""
    column = whole(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    right = sizes == width
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    out = np.zeros((len(sizes), width))
    if right.any():
        out[right] = values[starts[right][:, None] + np.arange(width)]
    usable = right & np.isfinite(out).all(1) & (out != 0).any(1)
    return out, usable


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept by Newton steps with a small ridge; for calibration on few columns. Rows count by ``weight``."""
    weight = np.ones(len(x)) if weight is None else weight
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (weight * p * (1 - p)) @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w

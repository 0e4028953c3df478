"""Tables of vectors: which take part, bounded samples of them, and rows that hold many of them as one block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """Whether a vector is there, and every component a finite number."""
    values = F.col(vector).cast("array<double>")
    return F.coalesce(~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def sampled(rows: DataFrame, key: str, count: int, size: int) -> DataFrame:
    """About ``size`` of ``count`` rows, chosen by a hash of their key; all of them if there are no more."""
    if count <= size:
        return rows
    share = int((1 << 30) * size / count)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share).limit(2 * size)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of numbers; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def stored(columns: dict) -> bytes:
    """Columns of one block as an Arrow stream."""
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read(body: bytes) -> dict[str, np.ndarray]:
    """Columns of a block; lists are laid end to end."""
    table = pa.ipc.open_stream(pa.py_buffer(body)).read_all()
    columns = {name: table.column(name).combine_chunks() for name in table.column_names}
    return {name: np.asarray(c.flatten() if pa.types.is_fixed_size_list(c.type) else c) for name, c in columns.items()}


def lists(values: np.ndarray) -> pa.FixedSizeListArray:
    """Rows of numbers as a column of lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])


def farthest_first(points: np.ndarray, count: int, least: float = 1e-9) -> np.ndarray:
    """Up to ``count`` distinct points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < count and gap.max() > least:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of every row of a to every row of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))

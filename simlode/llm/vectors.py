"""Vector columns as matrices, and the grid that keeps pair work within bounded blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(df: DataFrame, vector: Column, dimension: int) -> DataFrame:
    """The rows whose vector has the dimension, no null, only finite components and one that is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(vector.isNotNull() & (F.size(vector) == dimension) & fine & F.exists(vector, lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """An Arrow list column of sound vectors as float32 rows."""
    if isinstance(column, pa.ChunkedArray):
        parts = [matrix(c, dimension) for c in column.chunks]
        return np.concatenate(parts) if parts else np.empty((0, dimension), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest component first becomes 1, so nothing under- or overflows."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow binary column."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def from_binary(column: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """A binary column of rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        parts = [from_binary(c, width, kind) for c in column.chunks]
        return np.concatenate(parts) if parts else np.empty((0, width), kind)
    if not len(column):
        return np.empty((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def packed(df: DataFrame, dimension: int) -> DataFrame:
    """The rows with a sound vector ``v`` (as in :func:`sound`), which becomes its bytes: single precision, -0 as 0."""
    others = [c for c in df.columns if c != "v"]

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            flat = column.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
            offsets = column.offsets.to_numpy()
            at = np.flatnonzero(np.diff(offsets) == dimension)
            rows = flat[(offsets[at] - offsets[0])[:, None] + np.arange(dimension)].astype(np.float32, copy=False) + np.float32(0) if len(at) else np.empty((0, dimension), np.float32)
            fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
            keep = pa.array(at[fine])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in others), binary(rows[fine])], names=[*others, "v"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in others)
    return df.where("v IS NOT NULL").select(*others, "v").mapInArrow(run, f"{schema}, v binary")

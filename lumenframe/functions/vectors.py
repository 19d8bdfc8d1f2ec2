"""Arrow batches as NumPy matrices and back, and map jobs that add columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Partial sums meet in so many groups first, then those meet.
GROUPS = 64


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros((0, 0), dtype)
    if len(flat) % n or column.null_count:
        raise ValueError("vectors of one length are needed")
    out = flat.astype(dtype).reshape(n, -1)
    if not (np.diff(column.offsets.to_numpy()) == out.shape[1]).all():
        raise ValueError("vectors of one length are needed")
    return out


def lists(values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    """A matrix as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values.reshape(-1), kind))


def bytes_matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix of bytes: a view of the column's own buffer."""
    n = len(column)
    if n == 0:
        return np.zeros((0, 0), np.uint8)
    wide = column.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1]
    if column.null_count or (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("values of one length are needed")
    return np.frombuffer(wide.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(n, -1)


def binaries(values: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    n, d = values.shape
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * d), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def add_columns(df: DataFrame, make: Callable[..., dict[str, pa.Array]], inputs: list[str], fields: str, drop: tuple = ()) -> DataFrame:
    """df with the columns of ``fields`` that make(*columns of inputs) gives, batch by batch; a map job without a shuffle."""
    added = StructType.fromDDL(fields)
    new = added.names
    kept = [f for f in df.schema if f.name not in new and f.name not in drop]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            made = make(*[b.column(c) for c in inputs])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[made[c] for c in new]], names=[*names, *new])

    return df.mapInArrow(run, StructType([*kept, *added.fields]))


def sum_arrays(df: DataFrame, keys: list[str], ddl: str, column: str = "sums", count: str = "n") -> DataFrame:
    """Element-wise sums of an array column and of a count, by keys: one row a task and key comes in.

    The rows of a key meet in GROUPS groups and then in one, and are added up as they come, so no task holds them all.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, head = 0.0, 0.0, None
        for b in batches:
            if b.num_rows:
                total = total + matrix(b.column(column)).sum(axis=0, keepdims=True)
                n += float(np.sum(b.column(count).to_numpy()))
                head = head or {k: b.column(k).slice(0, 1) for k in (*keys, *extra)}
        if head:
            yield pa.RecordBatch.from_pydict(head | {count: pa.array([n]), column: lists(total)}).select([*extra, *names])

    names, extra = StructType.fromDDL(ddl).names, ["_group"]
    first = df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy(*keys, "_group").applyInArrow(add, "_group int, " + ddl)
    return first.groupBy(*keys).applyInArrow(add, "_group int, " + ddl).drop("_group")

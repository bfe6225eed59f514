"""Prefix sums inside an array column.

Spark has no linear-time scan over array elements: ``aggregate`` with a
growing array accumulator copies the array on every step (quadratic in the
array length), and a row window needs a shuffle by the row key.  A single
Arrow-batched UDF does the scan in O(n) with NumPy over the flattened child
values of a whole batch, with no per-row Python loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


SLICE_VALUES = 1 << 20


def in_slices(fn: Callable[[pa.Array], pa.Array], arr: pa.Array, values: int = SLICE_VALUES) -> pa.Array:
    """``fn`` of a list array, applied to stretches of rows of about ``values``
    elements: what it holds besides its result doesn't grow with the batch."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr.values) <= values:
        return fn(arr)
    return pa.concat_arrays([fn(arr.slice(at, n)) for at, n in row_slices(arr, values)])


def row_slices(arr: pa.ListArray, values: int = SLICE_VALUES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of about ``values`` elements, or one row;
    an array without rows gives one empty stretch."""
    offsets = np.asarray(arr.offsets, dtype=np.int64)
    at = 0
    while True:
        end = min(len(arr), max(at + 1, int(np.searchsorted(offsets, offsets[at] + values, side="right")) - 1))
        yield at, end - at
        at = end
        if at >= len(arr):
            return


def _running_sum_arrow(arr: pa.Array) -> pa.Array:
    return in_slices(_running_sum_rows, arr)


def _running_sum_rows(arr: pa.Array) -> pa.Array:
    offsets = np.asarray(arr.offsets, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    vals = arr.values.slice(lo, hi - lo)
    flat = np.asarray(vals.fill_null(0), dtype=np.int64) if len(vals) else np.zeros(0, np.int64)
    cs = np.cumsum(flat, dtype=np.int64)
    rel = offsets - lo
    lengths = np.diff(rel)
    base = np.concatenate([[0], cs])[rel[:-1]]
    out = cs - np.repeat(base, lengths)
    mask = arr.is_null()
    return pa.ListArray.from_arrays(pa.array(rel.astype(np.int32)), pa.array(out, pa.int64()),
                                    mask=mask if arr.null_count else None)


_running_sum_udf = F.arrow_udf(_running_sum_arrow, T.ArrayType(T.LongType()))


def running_sum(c: Column) -> Column:
    """Inclusive prefix sums of an ``array<int|long>`` (nulls count as 0)."""
    return _running_sum_udf(c.cast("array<long>"))


def exclusive_running_sum(c: Column) -> Column:
    """Sum of the elements before each position (first element -> 0)."""
    cs = running_sum(c)
    return F.zip_with(cs, c.cast("array<long>"), lambda s, x: s - F.coalesce(x, F.lit(0)))

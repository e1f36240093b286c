"""Helpers of the operators over vectors: valid rows, Arrow lists as matrices, ordered cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def matrix(lists, dims: int) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) if len(lists) else np.empty(0, np.int64)
    if len(flat) == len(lists) * dims and (sizes == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def first_of_each(owner: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner: highest score first, ties to the smaller name."""
    order = np.lexsort((name, -score, owner))
    if not len(order):
        return order
    owned = owner[order]
    starts = np.flatnonzero(np.r_[True, owned[1:] != owned[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]

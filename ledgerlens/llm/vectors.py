"""Helpers for operators on vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPACE = 1 << 64


def finite(vec: Column) -> Column:
    """True for an array without a null, NaN or infinite component, false for all else (a null array too)."""
    return F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def matrices(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each vector length of a batch; no vector or component is null."""
    lists = batch.column(column)
    flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    off = off - off[0]
    dims = np.diff(off)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, flat[off[rows][:, None] + np.arange(dim)]


def lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """The rows of a matrix as a list array."""
    off = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32) if matrix.shape[1] else np.zeros(len(matrix) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums per column, as Python integers."""
    small = len(x) == 0 or int(max(x.max(), -x.min())) < (1 << 62) // max(1, len(x))
    return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)


def below(digest: Column, share: float) -> Column:
    """Rows whose lowercase hex digest lies in the lowest ``share`` of all values; all rows, null digests too, from 1 on."""
    if share >= 1.0:
        return F.lit(True)
    return digest < F.lit(f"{int(share * HASH_SPACE):016x}")


def smallest(df: DataFrame, digest: str, others: list[str], total: int, wanted: int) -> list:
    """The ``wanted`` first rows of ``df`` by digest, then ``others``, each as often as it occurs.

    A hash threshold that about four times as many rows pass, doubled where too few do, filters first, so that
    what reaches the driver depends neither on the number of rows nor on that of partitions.
    """
    share = 4.0 * wanted / max(1, total)
    while True:
        rows = (df.where(below(F.col(digest), share)).groupBy(digest, *others).agg(F.count(F.lit(1)).alias("times"))
                .orderBy(F.col(digest).asc_nulls_last(), *others).limit(wanted).collect())
        found = [r for r in rows for _ in range(min(wanted, r["times"]))]
        if len(found) >= wanted or share >= 1.0:
            return found[:wanted]
        share *= 8.0

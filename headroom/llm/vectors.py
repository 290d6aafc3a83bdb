"""Vectors in Arrow batches: which are usable, and their matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, and without null or non-finite entries; an empty vector is usable."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, finite), F.lit(False))


def scaled(lists: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) of usable vectors as whole numbers, a row each, with their lengths; what a shorter vector lacks is 0.

    A product of 2^53 or more in size is refused, as doubles stand further apart than 1 there.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    if len(values) and np.abs(values).max() >= 2.0**53:
        raise ValueError(f"an entry times {factor} is not below 2^53")
    out = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values.astype(np.int64)
    return out, lengths

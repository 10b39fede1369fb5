"""Vector columns inside tasks: to matrices, and which rows take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """True for a vector that is not null and whose components are all non-null and finite."""
    c = F.col(c) if isinstance(c, str) else c
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; none may be zero. Dividing by the largest component first keeps squares finite."""
    m = m / np.abs(m).max(1, keepdims=True, initial=0.0)
    return m / np.sqrt((m * m).sum(1, keepdims=True))

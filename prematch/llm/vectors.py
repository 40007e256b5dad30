"""What the vector operators share: which vectors take part, and arrays of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null or zero and has neither null nor non-finite components.

    Vectors of another than the most frequent length (ties: the longer) take no part.
    """
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0))
    sizes = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(column) == (sizes.n if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))

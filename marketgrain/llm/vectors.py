"""Whole Arrow columns of vectors as matrices.

A table's vectors have the length that most of its vectors have (of several such lengths the greatest). A vector that is
null, has another length, or holds a null or non-finite entry counts as missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(rows: DataFrame, column: str) -> int:
    """The length that most vectors have; 0 if there is none."""
    sizes = rows.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most is not None else 0


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows whose vectors count, and these vectors as doubles."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == length)
    entries = column.take(pa.array(rows)).flatten().cast(pa.float64())
    found = pc.fill_null(entries, np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    whole = np.isfinite(found).all(axis=1)
    return rows[whole], found[whole]

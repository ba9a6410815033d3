"""Reading vector columns as matrices, and dealing buckets of them out to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector has components, all of them finite, and not all of them zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & ~bad & some, F.lit(False))


def matrix(rows: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    if not len(rows):
        return np.zeros((0, 0))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def only_length(vectors: DataFrame, column: str) -> int:
    """The one length of all vectors; 0 for an empty table, an error if there are several."""
    found = [r[0] for r in vectors.select(F.size(column).alias("n")).distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError("vectors of different length")
    return found[0] if found else 0


def sizes_above(bucketed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys, parts``: the buckets with more than ``most`` rows, and into how many parts they go."""
    counts = bucketed.groupBy(*keys).count().where(F.col("count") > most)
    return counts.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts"))

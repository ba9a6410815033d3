"""Row numbers over large groups: block counts, offsets, then numbers inside a block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks import schema


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """Dense numbers from 1 within ``keys`` in ``order``, without one task per key.

    ``block`` cuts a key into ordered ranges: never null, never less along ``order``. Rows are
    shuffled once by (keys, block); only one count per block is ordered within a key.
    """
    # A struct is never null, so rows whose key is null are numbered like any other.
    cells = ["_key", "_block"]
    placed = df.withColumns({"_key": F.struct(F.lit(0), *keys), "_block": block})
    sizes = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy("_key")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = sizes.withColumn("_offset", F.sum("_size").over(earlier) - F.col("_size"))
    if total:
        offsets = offsets.withColumn(total, F.sum("_size").over(Window.partitionBy("_key")))
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(*order))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets.drop("_size"), cells)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop(*cells, "_inside", "_offset")
    )


def assign_batches(
    df: DataFrame,
    batch_size: int,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
) -> DataFrame:
    """``batch_no`` and ``total_batches`` of loads of ``batch_size`` rows within ``keys``.

    A size below 1 or above the number of rows falls back to the default of 100.
    """
    numbered = number_rows(df, keys, order, block, "_row", "_rows")
    given = F.lit(batch_size)
    size = F.when((given < 1) | (given > F.col("_rows")), schema.DEFAULT_BATCH_SIZE).otherwise(
        given
    )
    return numbered.withColumns(
        {
            "batch_no": F.ceil(F.col("_row") / size),
            "total_batches": F.ceil(F.col("_rows") / size),
        }
    ).drop("_row", "_rows")

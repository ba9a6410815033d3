"""The NOT NULL contract of the vector table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.schema import VECTOR_TABLE


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, null_count`` from one pass and one map-side aggregate."""
    names = list(columns or VECTOR_TABLE.fieldNames())
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "null_count")


def _refuse(name: str) -> Column:
    return F.raise_error(F.lit(f"column {name} must not be null"))


def present(field: T.StructField) -> Column:
    """The column, or an error that stops the job where it, or an element of it, is null."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.ArrayType) and field.dataType.containsNull:
        column = F.transform(column, lambda x: F.coalesce(x, _refuse(field.name)))
    return F.coalesce(column, _refuse(field.name)).alias(field.name)


def table_columns(df: DataFrame) -> DataFrame:
    """Exactly the columns of the vector table, in order, of its types and without nulls."""
    types = [f.dataType.simpleString() for f in VECTOR_TABLE]
    chosen = df.select(*VECTOR_TABLE.fieldNames())
    return chosen.select(
        *[present(f).cast(t).alias(f.name) for f, t in zip(chosen.schema, types)]
    )

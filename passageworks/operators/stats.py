"""Counts, shares and rates over an ingest or its event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest_counts(documents: DataFrame, chunks: DataFrame, group: str = "repo_name") -> DataFrame:
    """Files, files without a version and chunks of every group."""
    files = documents.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("document_version").isNull()).alias("unversioned"),
    )
    made = chunks.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("chunks"))
    joined = files.join(made, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return joined.na.fill(0, ["chunks"])


def share_of_total(
    df: DataFrame, part: Sequence[str], whole: Sequence[str], amount: Column, digits: int = 6
) -> DataFrame:
    """``amount`` of each ``part`` in percent of its ``whole``; both are sums.

    The whole is summed from the parts, so the rows are shuffled once and then only their sums.
    """
    parts = df.groupBy(*part).agg(F.sum(amount).alias("amount"))
    # A struct is never null, so a null key has a whole like any other.
    keyed = parts.withColumn("_key", F.struct(F.lit(0), *whole))
    wholes = keyed.groupBy("_key").agg(F.sum("amount").alias("_whole"))
    share = F.try_divide(F.col("amount").cast("double") * 100, F.col("_whole").cast("double"))
    return keyed.join(wholes, "_key").select(
        *part, "amount", F.round(share, digits).alias("share")
    )


def throughput(df: DataFrame, keys: Sequence[str], ts: str, digits: int = 6) -> DataFrame:
    """Rows per second between the first and the last row of a key, 0 when no time passed."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(
        F.min(ts).cast("timestamp")
    )
    rate = F.try_divide(F.count(F.lit(1)) * 1e6, seconds.cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.coalesce(rate, F.lit(0.0)), digits).alias("rows_per_second"),
    )

"""Folders of a table that Spark's readers skip: listing them, marks in them, and rows by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    files, folder = _located(spark, path)
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def put_mark(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it was there, so of several writers one gets it."""
    files, file = _located(spark, path)
    return files.createNewFile(file)


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _located(spark, path)
    files.delete(folder, True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_in(rows: DataFrame, bucket: Column) -> list[int]:
    """The buckets that rows fall into; the number of buckets bounds the list."""
    return sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())


def append_bucketed(rows: DataFrame, path: str, *folders: str, gather: bool = True) -> None:
    """Append rows by ``bucket`` and further ``folders``: a few files for each, whatever the tasks.

    Rows that were shuffled just before lie in few tasks already; these need not ``gather`` again.
    """
    rows = rows.hint("rebalance", "bucket") if gather else rows
    rows.write.mode("append").option("compression", "zstd").partitionBy("bucket", *folders).parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets; only their folders are read. None where nothing was written."""
    if not buckets or not names_in(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(list(buckets)))

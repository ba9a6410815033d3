"""Tables written between two steps, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from passageworks.session import small_batches  # noqa: F401

Sent = TypeVar("Sent")


def send(spark: SparkSession, value: Sent) -> Callable[[], Sent]:
    """A broadcast of ``value``, which a task gets by calling the result once.

    Broadcasts are pickled by reference to their classes. Bytes made here carry the classes of this
    package along (see ``send_code_with_tasks``), so workers need not have it installed.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(data.value)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"llm-{spark.sparkContext.applicationId}")
    return base.rstrip("/")


def release() -> None:
    """Give what earlier tasks of this worker freed back to the system.

    Workers are used again for later tasks, while their allocators keep freed memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def written(df: DataFrame, name: str, bucketed: tuple[int, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own: computed once, its lineage cut, its columns prunable.

    A lost executor loses nothing of it. The table lies under the application's name, so it can
    be removed with it. With ``bucketed``, a number and a column, it is dealt to that many buckets
    by the column, and grouping by the column does not shuffle it; the catalog lists it no longer
    than it takes to read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if bucketed:
        entry = f"{name}_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(*bucketed).saveAsTable(entry)
        table = spark.table(entry)
        spark.sql(f"DROP TABLE {entry}")  # of an external table, the files stay
        return table
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results read from them must be saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    )
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

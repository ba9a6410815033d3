"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import importlib
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle partitions and splits skewed ones.
# Documents are wide rows, so Arrow batches are kept short: one batch must stay far
# below the 2 GB limit of a string column even with texts of a megabyte.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app: str = "passageworks", master: str | None = None, **extra: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most BATCH_BYTES.

    A batch of documents lies in the executor's JVM, in the pipe and in the worker at once, so with
    batches of 64 MB, the default, the tasks of an executor hold several hundred MB more.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864b").rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, seen by all executors, for a table written between two steps."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="passageworks-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def send_code_with_tasks() -> None:
    """Pickle this package's functions by value, for workers on which it is not installed."""
    cloudpickle.register_pickle_by_value(importlib.import_module(__package__))

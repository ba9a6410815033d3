"""Chat histories kept as text files, one per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passageworks import schema
from passageworks.functions.text import unify_newlines
from passageworks.operators.history import classify


def read_history_files(
    spark: SparkSession,
    path: str,
    separator: str = schema.HISTORY_SEPARATOR,
    session: str = r"/(?:chat_history_)?([^/]*?)(?:\.txt)?$",
) -> DataFrame:
    """``conv_id, turn, role, text`` of all sessions; ``session`` finds the id in a file's path.

    The separator is the reader's line end: a message is a row from the start, and a history of
    any size is read by many tasks. A turn is its place in its split behind the turns of the
    splits before, so no task numbers a whole file.
    """
    raw = spark.read.option("lineSep", separator).text(path)
    messages = (
        raw.select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_at"),
            classify(unify_newlines(F.col("value"))).alias("_spoken"),
        )
        .filter("_spoken is not null")
        .select("_file", "_split", "_at", "_spoken.role", "_spoken.text")
    )
    sizes = messages.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_file").orderBy("_split")
    starts = sizes.select(
        "_file", "_split", (F.sum("_size").over(before) - F.col("_size")).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_at"))
    return (
        messages.withColumn("_place", place)
        .join(starts, ["_file", "_split"])
        .select(
            # The path is URL-encoded; a plus sign in it stands for itself.
            F.url_decode(F.replace(F.regexp_extract("_file", session, 1), F.lit("+"), F.lit("%2B"))).alias("conv_id"),
            (F.col("_start") + F.col("_place") - 1).alias("turn"),
            "role",
            "text",
        )
    )

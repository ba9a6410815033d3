"""What a vector table holds, by bucket: the keys of its rows and one vector for each of its texts.

Both lie beside the table, in folders by a hash: keys by document, vectors by text. A load reads the
buckets that its documents and its texts fall into, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.operators.embedding import VECTOR
from passageworks.schema import CHUNK_KEY, VECTOR_TABLE
from passageworks.sources import folders
from passageworks.sources.table_log import Loads

BUCKETS = 16  # of a new table; a table keeps the number it was made with
MOST_SENT = 1 << 16  # texts up to which their keys are sent to the tasks
TEXT_KEY = ("chunk_id", "chunking_strategy", "embedding_model")
_INT = T.IntegerType()
KEYS = T.StructType([*(VECTOR_TABLE[c] for c in CHUNK_KEY), T.StructField("bucket", _INT), T.StructField("load", _INT)])
VECTORS = T.StructType(
    [*(VECTOR_TABLE[c] for c in TEXT_KEY), T.StructField("embedding", VECTOR), T.StructField("bucket", _INT)]
)


def _place(spark: SparkSession, path: str, name: str, buckets: int) -> tuple[str, int]:
    """The folder of a store and its number of buckets, which is part of the folder's name."""
    made = [n for n in folders.names_in(spark, f"{path}/{name}") if n.startswith("of-")]
    buckets = int(made[0][3:]) if made else buckets
    return f"{path}/{name}/of-{buckets}", buckets


def has_keys(spark: SparkSession, path: str) -> bool:
    return bool(folders.names_in(spark, f"{path}/_keys"))


def stored_keys(
    spark: SparkSession, path: str, documents: DataFrame, loads: Loads, buckets: int = BUCKETS
) -> DataFrame | None:
    """The committed keys in the buckets of ``documents``; nothing where there are none."""
    if not has_keys(spark, path):
        return None
    place, n = _place(spark, path, "_keys", buckets)
    touched = folders.buckets_in(documents, folders.bucket_of("document_id", n))
    return folders.read_bucketed(spark, place, KEYS, touched).where(loads.seen()).select(*CHUNK_KEY)


def add_keys(rows: DataFrame, path: str, load: int, buckets: int = BUCKETS) -> None:
    place, n = _place(rows.sparkSession, path, "_keys", buckets)
    keyed = rows.select(*CHUNK_KEY).withColumns({"bucket": folders.bucket_of("document_id", n), "load": F.lit(load)})
    folders.append_bucketed(keyed, place, "load")


def _vector_rows(spark: SparkSession, path: str, texts: DataFrame, buckets: int) -> DataFrame | None:
    """All vectors in the buckets of ``texts``; nothing where there are none."""
    place, n = _place(spark, path, "_vectors", buckets)
    if not folders.names_in(spark, place):
        return None
    touched = folders.buckets_in(texts, folders.bucket_of("chunk_id", n))
    return folders.read_bucketed(spark, place, VECTORS, touched) if touched else None


def of_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows with a key among ``texts`` (TEXT_KEY, each once), whose keys are sent if they are few."""
    wanted = texts.select(*TEXT_KEY)
    return rows.join(F.broadcast(wanted) if texts.count() <= MOST_SENT else wanted, list(TEXT_KEY), "left_semi")


def without_vectors(spark: SparkSession, path: str, texts: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """The keys of ``texts`` (TEXT_KEY) of which no vector is stored; nothing where there are no vectors."""
    rows = _vector_rows(spark, path, texts, buckets)
    return None if rows is None else texts.select(*TEXT_KEY).join(rows.select(*TEXT_KEY), list(TEXT_KEY), "left_anti")


def stored_vectors(spark: SparkSession, path: str, texts: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """One vector for each key of ``texts`` (TEXT_KEY) that has one, from the buckets of the texts.

    Where the texts are too many to be sent, other texts of their buckets are among them. Nothing
    where no vector is stored.
    """
    rows = _vector_rows(spark, path, texts, buckets)
    if rows is None:
        return None
    some = of_texts(rows, texts) if texts.count() <= MOST_SENT else rows
    return some.repartition("chunk_id").groupBy(*TEXT_KEY).agg(F.any_value("embedding").alias("embedding"))


def add_vectors(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store one vector of each text of ``rows``."""
    place, n = _place(rows.sparkSession, path, "_vectors", buckets)
    once = rows.groupBy(*TEXT_KEY).agg(F.any_value("embedding").alias("embedding"))
    folders.append_bucketed(once.withColumn("bucket", folders.bucket_of("chunk_id", n)), place, gather=False)


def index_table(table: DataFrame, path: str, load: int, buckets: int = BUCKETS) -> None:
    """Both stores for a table that was written without them, in two scans of it."""
    add_vectors(table, path, buckets)
    add_keys(table, path, load, buckets)

"""The loads of a vector table: which rows are committed, and which of them are valid.

Every load has a number, and its rows lie in folders of that number. A load counts from the moment
its mark is put, so what a stopped load left behind is never read. The log holds each document's
version and access flag as of the loads that changed them, by bucket of the document, with the state
that such a change made invalid. A snapshot is the state after a load: readers that name none
get the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.sources import folders

LOG = "_log"
BUCKETS = 16
STATE = ["document_id", "document_version", "internal_only"]
_STATES = [
    T.StructField("document_id", T.StringType()),
    T.StructField("document_version", T.StringType()),
    T.StructField("internal_only", T.BooleanType()),
]
_NUMBER = T.StructField("load", T.IntegerType())
_FORMER = [T.StructField("former_version", T.StringType()), T.StructField("former_internal", T.BooleanType())]
DOCUMENTS = T.StructType([*_STATES, *_FORMER, T.StructField("bucket", T.IntegerType()), _NUMBER])


@dataclass(frozen=True)
class Loads:
    """The last committed load, and the earlier ones that were begun and never committed."""

    last: int
    stopped: tuple[int, ...] = ()

    def seen(self, snapshot: int | None = None) -> Column:
        """Whether a row's ``load`` belongs to the snapshot."""
        known = F.col("load") <= (self.last if snapshot is None else min(snapshot, self.last))
        return known & ~F.col("load").isin(list(self.stopped)) if self.stopped else known


def find_loads(spark: SparkSession, path: str) -> Loads | None:
    """The loads of the table at ``path``; none if it has no log."""
    begun = folders.names_in(spark, f"{path}/{LOG}/begun")
    if not begun:
        return None
    done = {int(n) for n in folders.names_in(spark, f"{path}/{LOG}/committed")}
    last = max(done, default=0)
    return Loads(last, tuple(sorted(n for n in map(int, begun) if n < last and n not in done)))


def begin(spark: SparkSession, path: str) -> int:
    """The number of a new load, which no other load has or will have."""
    number = max(map(int, folders.names_in(spark, f"{path}/{LOG}/begun")), default=0) + 1
    while not folders.put_mark(spark, f"{path}/{LOG}/begun/{number}"):
        number += 1
    return number


def _states(spark: SparkSession, path: str, buckets: list[int], loads: Loads) -> DataFrame:
    """``document_id, s``: the newest state of each document of some buckets."""
    rows = folders.read_bucketed(spark, f"{path}/{LOG}/documents", DOCUMENTS, buckets)
    return rows.where(loads.seen()).groupBy("document_id").agg(
        F.max_by(F.struct("document_version", "internal_only"), "load").alias("s")
    )


def record(spark: SparkSession, path: str, load: int, documents: DataFrame) -> None:
    """Log the states of ``documents`` where they are new. The load is not committed by this."""
    listed = documents.groupBy("document_id").agg(F.max(F.struct("document_version", "internal_only")).alias("n"))
    bucket = folders.bucket_of("document_id", BUCKETS)
    loads = find_loads(spark, path) or Loads(0)
    before = _states(spark, path, folders.buckets_in(documents, bucket), loads)
    changed = listed.join(before, "document_id", "left").where(~F.col("n").eqNullSafe(F.col("s")))
    new = changed.select(
        "document_id", "n.*", F.col("s.document_version").alias("former_version"),
        F.col("s.internal_only").alias("former_internal"), bucket.alias("bucket"), F.lit(load).alias("load"),
    )
    folders.append_bucketed(new, f"{path}/{LOG}/documents", "load")


def commit(spark: SparkSession, path: str, load: int) -> None:
    folders.put_mark(spark, f"{path}/{LOG}/committed/{load}")


def keep_vectors(spark: SparkSession, path: str, load: int) -> None:
    """Mark that the vectors of a load's rows are stored by text."""
    folders.put_mark(spark, f"{path}/{LOG}/vectors/{load}")


def without_vectors(spark: SparkSession, path: str) -> list[int]:
    """Loads that were begun and neither committed nor marked by ``keep_vectors``."""
    begun, *done = (set(folders.names_in(spark, f"{path}/{LOG}/{name}")) for name in ("begun", "committed", "vectors"))
    return sorted(map(int, begun.difference(*done)))


def invalid_states(spark: SparkSession, path: str, loads: Loads, snapshot: int | None = None) -> DataFrame:
    """``document_id, document_version, internal_only`` stored earlier and not valid in the snapshot.

    Only documents that ever changed have such rows, so the list grows with the changes, not with
    the table.
    """
    log = f"{path}/{LOG}/documents"
    if not folders.names_in(spark, log):
        return spark.createDataFrame([], T.StructType(_STATES))
    changes = spark.read.schema(DOCUMENTS).parquet(log).where(loads.seen(snapshot)).where("former_version IS NOT NULL")
    former = F.struct(
        F.col("former_version").alias("document_version"), F.col("former_internal").alias("internal_only"), F.lit(False).alias("valid")
    )
    now = F.struct("document_version", "internal_only", F.lit(True).alias("valid"))
    events = changes.select("document_id", "load", F.explode(F.array(former, now)).alias("e")).select("document_id", "load", "e.*")
    states = events.groupBy(*STATE).agg(F.max_by("valid", "load").alias("valid"))
    return states.where("NOT valid").select(*STATE)

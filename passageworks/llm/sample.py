"""Labelled rows to learn from: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, most: int, text: str = "text"
) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` documents of each label.

    Ids are taken in the order of a hash, so the sample is the same in every run and a new row
    changes it only by its own place. Labels that contradict each other count as the greater one;
    null ids and labels are left out, as are labels without a document. The ids are at most
    2 * ``most`` rows, which bounds what is broadcast.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("order", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select("doc_id", text).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")

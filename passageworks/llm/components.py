"""Connected components of a graph in the cluster, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger neighbours (or smaller ones and itself) on its least neighbour.

    The least neighbour is a map-side combined minimum that is joined back, so a node of very high
    degree is never gathered in one task: its rows are only streamed through a join that adaptive
    execution may split.
    """
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u")
    if large:
        return hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    return hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the least node it can reach) of every node of an edge.

    Null ends, loops, doubled edges and either direction are allowed; an empty table gives none.
    Every round is checkpointed to the shared folder, so lost executors lose no round. Kiveris and
    others (2014) give the method; the number of rounds grows with the logarithm of the size.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct().checkpoint()
    )
    before = None
    for _ in range(rounds):
        now = _star(_star(now, True).where("u <> v"), False).where("u <> v").distinct().checkpoint()
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")),
            F.sum(F.hash("u", "v").cast("long")),
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

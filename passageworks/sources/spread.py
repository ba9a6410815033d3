"""Tasks for inputs that come in fewer files than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer splits than cores, hashed by ``keys`` over all cores.

    Such an input is small by definition (less than one split per core), so its shuffle is
    cheap next to chunking and embedding it. Any larger input is returned as it is. Give a scan,
    not a plan with joins: asking for its partitions runs nothing then.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)

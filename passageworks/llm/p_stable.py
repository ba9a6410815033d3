"""Nearest neighbours by multiprobe p-stable hashing.

A table projects vectors on ``dims`` random Gaussian directions and cuts each projection into
cells of one width; a bucket is a tuple of cells. A query visits buckets of every table in the
order of the estimated probability that a neighbour at distance r lies there: its projections
differ by normal numbers of deviation r, so a bucket's probability is a product over the
directions. It stops when the visited buckets hold a neighbour with probability TARGET over all
tables. Candidates are ranked by exact Euclidean distance in double precision.

r is measured: for a few sampled queries the distance of the k-th neighbour is found exactly, in
one scan, and its median is r in the first round. The k-th distance that a query finds there bounds
its own from above; where it is larger than r, the query probes again with it as its r. Queries
that found fewer than k, or for which that would be too many buckets, are compared with all
vectors, block by block. The number of directions grows with the logarithm of the number of vectors, so buckets
keep their size. Buckets beyond CHUNK vectors are cut into chunks that a query visits one by one.
No candidate list is capped: a task keeps, per query, the k best of all candidates it has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.flat import mix
from passageworks.llm.store import written
from passageworks.llm.vectors import matrix, only_length, sizes_above, usable

TABLES = 4
TARGET = 0.95  # estimated probability that a neighbour is met
BUCKET = 512  # vectors of a bucket on average, by which the number of directions is chosen
CELLS = 2.0  # width of a cell, in deviations of the projections
CHUNK = 4096  # vectors of a chunk of a large bucket
SAMPLED = 64  # queries for which r is measured
HELD = 20_000  # queries whose best candidates a task holds before it hands them on
MOST_PROBES = 1 << 16  # buckets of a table beyond which a query is compared with all vectors
QUERY_BLOCK = 1 << 24  # bytes of queries that are compared with all vectors in one scan
BEAM = 4096  # partial buckets kept at first, four times as many whenever they do not suffice


def directions(dim: int, dims: int, tables: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (tables x dim x dims) and offsets in [0, 1) (tables x dims)."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, dim, dims)), rng.random((tables, dims))


def bucket_key(table: int, cells: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of cells."""
    out = np.full(len(cells), np.uint64(table + 1))
    for k in range(cells.shape[1]):
        out = mix(out + cells[:, k].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


def probes(place: np.ndarray, spread: float, target: float, most: float = math.inf) -> np.ndarray | None:
    """Cells of the buckets to visit for a query, most probable first; None if over ``most``.

    ``place`` are its projections in cells, ``spread`` the deviation of a neighbour in cells.
    Directions are added one by one; after each, the most probable partial buckets are kept.
    """
    reach = max(1, math.ceil(3 * spread))
    offsets = np.arange(-reach, reach + 1)
    home = np.floor(place).astype(np.int64)
    low = home[:, None] + offsets[None, :]
    share = _normal((low + 1 - place[:, None]) / spread) - _normal((low - place[:, None]) / spread)
    beam = BEAM
    while True:
        cells, weight, cut = np.zeros((1, 0), dtype=np.int64), np.ones(1), False
        for k in range(len(place)):
            both = (weight[:, None] * share[k][None, :]).ravel()
            keep = np.argsort(-both, kind="stable")[:beam]
            cut |= len(keep) < len(both)
            cells = np.c_[cells[keep // len(offsets)], low[k][keep % len(offsets)]]
            weight = both[keep]
        total = np.cumsum(weight)
        if total[-1] >= target or not cut:
            cells = cells[: int(np.searchsorted(total, target)) + 1]
            return cells if len(cells) <= most else None
        if beam >= most:
            return None
        beam *= 4


class _Best:
    """The k nearest candidates so far of each of a number of queries."""

    def __init__(self, k: int):
        self.k = k
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids):
            return
        rough = (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :]
        few = min(2 * self.k + 2, len(ids))
        for i, query in enumerate(queries.tolist()):
            near = np.argpartition(rough[i], few - 1)[:few] if few < len(ids) else np.arange(len(ids))
            # The rough distances are off by rounding: all that could be among the best stay.
            if few < len(ids):
                near = np.flatnonzero(rough[i] <= rough[i][near].max() + 1e-9)
            near = near[ids[near] != query]
            d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
            old = self.rows.get(query)
            got = ids[near] if old is None else np.r_[old[0], ids[near]]
            d = d if old is None else np.r_[old[1], d]
            got, first = np.unique(got, return_index=True)
            d = d[first]
            order = np.lexsort((got, d))[: self.k]
            self.rows[query] = (got[order], d[order])

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, {}
        if not rows:
            return None
        queries = np.repeat(list(rows), [len(r[0]) for r in rows.values()])
        return pa.RecordBatch.from_arrays(
            [pa.array(queries, pa.int64()), pa.array(np.concatenate([r[0] for r in rows.values()]), pa.int64()),
             pa.array(np.concatenate([r[1] for r in rows.values()]), pa.float64())],
            names=["query_id", "vec_id", "score"],
        )


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct vectors of each query, with their rank."""
    ahead = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def measured_radius(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[float, float]:
    """The median distance of the k-th neighbour, and the deviation of a projection.

    Exact for at most SAMPLED queries (in the order of a hash of their id), in one scan.
    """
    some = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLED).collect()
    ids = np.array([r["id"] for r in some], dtype=np.int64)
    q = np.array([r["v"] for r in some], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            best.add(ids, q, batch.column(0).to_numpy(), matrix(batch.column(1)))
        if (out := best.take()) is not None:
            yield out

    found = vectors.select("id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    last = _best_of(found, k).groupBy("query_id").agg(F.max("score").alias("d")).collect()
    center = q.mean(axis=0)
    deviation = float(np.sqrt(((q - center) ** 2).sum(axis=1).mean()))
    # In the first round each query visits for a neighbour as far as the middle sampled query's
    # last one. A few queries may lie closer together than the vectors do: cells are never far
    # below the radius.
    radius = float(np.median([r["d"] for r in last])) if last else 0.0
    return radius, max(deviation, radius / 2)


def _compared_with_all(good: DataFrame, queries: DataFrame, k: int, dim: int) -> list[DataFrame]:
    """The best of all vectors for each query, exactly: a scan for each block of queries."""
    session, size = good.sparkSession, max(1, QUERY_BLOCK // (8 * max(1, dim)))

    def scan(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        sent = session.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, q), best = sent.value, _Best(k)
            for batch in batches:
                have, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for lo in range(0, len(ids), 1024):
                    best.add(ids[lo : lo + 1024], q[lo : lo + 1024], have, x)
            if (out := best.take()) is not None:
                yield out

        found = good.select("id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        return written(found, "compared")

    out, block = [], []
    for row in queries.select("id", "v").toLocalIterator():
        block.append(row)
        if len(block) == size:
            out.append(scan(np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block])))
            block = []
    if block:
        out.append(scan(np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block])))
    return out


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding",
    target: float = TARGET, tables: int = TABLES, bucket: int = BUCKET,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every other row, for each query.

    Nearest first by Euclidean distance, ties by smaller id; all rows if there are fewer than k.
    Vectors that are null, zero or not finite throughout, and null ids, take no part. Rows that
    repeat an id are one vector: the nearer counts. An empty table gives none; vectors of
    different length are an error.
    """
    good = vectors.where(F.col(id).isNotNull() & usable(vector)).select(
        F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    good = written(good, "vectors")
    dim = only_length(good, "v")
    queries = good.where("query").select("id", "v")
    radius, deviation = measured_radius(good, queries, k) if dim else (0.0, 0.0)
    n = good.count()
    if radius == 0.0 and deviation == 0.0:
        deviation = 1.0
    width = CELLS * max(deviation, 1e-12)
    # At this width a direction tells about 1.9 cells apart (the exponential of their entropy).
    dims = max(2, math.floor(math.log(max(2, n / bucket)) / math.log(1.9)))
    turn, offset = directions(dim or 1, dims, tables)
    per_table = 1 - (1 - target) ** (1 / tables)

    def place(x: np.ndarray, t: int) -> np.ndarray:
        return x @ turn[t] / width + offset[t]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(tables):
                keys = bucket_key(t, np.floor(place(x, t)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns[:2]], names=["bucket", "id", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets that a query visits for neighbours as far as its r; null if too many."""
        for batch in batches:
            x, r = matrix(batch.column(1)), batch.column(2).to_numpy()
            for lo in range(len(x)):
                spread, keys = max(float(r[lo]), 1e-3 * deviation) / width, []
                for t in range(tables):
                    # Beyond 4 cells, nearly every bucket would have to be visited.
                    cells = probes(place(x[lo : lo + 1], t)[0], spread, per_table, MOST_PROBES) if spread <= 4 else None
                    keys.append(None if cells is None else pa.array(bucket_key(t, cells)))
                if any(key is None for key in keys):
                    keys = [pa.nulls(1, pa.int64())]
                keys = pa.concat_arrays(keys)
                yield pa.RecordBatch.from_arrays(
                    [keys, batch.column(0).take(pa.array(np.full(len(keys), lo)))], names=["bucket", "id"]
                )

    stored = good.select("id", "v").mapInArrow(index, "bucket bigint, id bigint, v array<double>")
    stored = written(stored, "buckets")
    large = sizes_above(stored, ["bucket"], CHUNK).checkpoint()
    placed = stored.join(large, "bucket", "left").select(
        "bucket", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part"),
        F.lit(1).alias("kind"), "id", "v",
    )
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    there = stored.select("bucket").distinct()

    def probed(asking: DataFrame) -> DataFrame:
        """``bucket, id`` of queries with their ``r``."""
        made = asking.select("id", "v", "r").repartition("id").mapInArrow(visits, "bucket bigint, id bigint")
        return written(made.distinct(), "visits")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, here = _Best(k), None
        ids, q = np.zeros(0, dtype=np.int64), np.zeros((0, dim))
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            kind, all_ids, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4))
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for part in np.split(np.arange(batch.num_rows), cuts):
                if not len(part):
                    continue
                if here != (now := tuple(keys[:, part[0]].tolist())):
                    here, ids, q = now, ids[:0], q[:0]
                ask, have = part[kind[part] == 0], part[kind[part] == 1]
                ids, q = np.r_[ids, all_ids[ask]], np.r_[q, x[ask]]
                if len(ids) and len(have):
                    for lo in range(0, len(ids), 1024):
                        best.add(ids[lo : lo + 1024], q[lo : lo + 1024], all_ids[have], x[have])
                if len(best.rows) > HELD and (out := best.take()) is not None:
                    yield out
        if (out := best.take()) is not None:
            yield out

    def met(visited: DataFrame) -> DataFrame:
        """The best of the buckets visited, for each query."""
        asked = (
            visited.join(there, "bucket", "left_semi").join(large, "bucket", "left")
            .select("bucket", F.explode(every).alias("part"), F.lit(0).alias("kind"), "id")
        )
        asked = asked.join(queries, "id").select("bucket", "part", "kind", "id", "v")
        both = placed.union(asked).withColumn("bin", F.xxhash64("bucket", "part"))
        dealt = both.repartition("bin").sortWithinPartitions("bucket", "part", "kind")
        found = dealt.drop("bin").mapInArrow(search, "query_id bigint, vec_id bigint, score double")
        return written(_best_of(found, k).drop("rank"), "met")

    visited = probed(queries.withColumn("r", F.lit(radius)))
    found = met(visited.where("bucket IS NOT NULL"))
    # What a query has found bounds its own distance: who was to look farther looks again.
    own = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("r"))
    own = queries.join(own.withColumnRenamed("query_id", "id"), "id", "left")
    own = written(own.withColumn("short", F.coalesce(F.col("n"), F.lit(0)) < k), "own")
    farther = own.where(~F.col("short") & (F.col("r") > max(radius, 1e-3 * deviation)))
    if not farther.isEmpty():
        again = probed(farther)
        found = found.union(met(again.where("bucket IS NOT NULL").join(visited, ["bucket", "id"], "left_anti")))
        visited = visited.union(again)
    left = visited.where("bucket IS NULL").select("id").union(own.where("short").select("id")).distinct()
    for rows in _compared_with_all(good, queries.join(left, "id", "left_semi"), k, dim):
        found = found.union(rows)
    return _best_of(found, k)

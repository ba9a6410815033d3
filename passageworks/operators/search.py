"""Exact top-k vector retrieval with access filter, for one question or a batch.

Scores are computed where the vectors are read: each task keeps its best ``k`` distinct rows per
question, so what is shuffled is ``tasks * questions * k`` short rows and never a pair list.
Questions are embedded and stored once and travel to the tasks in blocks of bounded size; a scan
meets many blocks. The table is neither shuffled nor copied, whatever the number of questions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks import schema
from passageworks.functions.vectors import METRICS, SCORE_DIGITS
from passageworks.session import shared_folder

# Questions are hashed into blocks of about this many bytes, the most that the driver holds at once.
BYTES_PER_BLOCK = 32 << 20
# Bytes of questions that a task holds; the blocks of a scan of the table come to as much.
BYTES_PER_SCAN = 256 << 20
ROWS_PER_STEP = 16_384
BYTES_PER_STEP = 32 << 20
CELLS_PER_STEP = 4_000_000

_HIT = [
    T.StructField("chunk_content", T.StringType()),
    T.StructField("document_name", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def searchable(
    table: DataFrame,
    strategy: str | None = None,
    model: str | None = None,
    is_customer: bool = True,
) -> DataFrame:
    """The rows a question may see; customers see no internal ones."""
    if strategy is not None:
        table = table.filter(F.col("chunking_strategy") == strategy)
    if model is not None:
        table = table.filter(F.col("embedding_model") == model)
    if is_customer:
        table = table.filter(~F.col("internal_only"))
    return table.select("chunk_content", "document_name", "embedding")


# ---------------------------------------------------------------- inside a task


def _matrix(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(sizes[0]) if len(sizes) else 0
    if len(sizes) and not (sizes == dim).all():
        raise ValueError("vectors of different length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), dim)


def _scores(name: str, vectors: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """One row per vector, one column per question; NaN where a cosine is undefined."""
    if name == "inner_product":
        found = vectors @ questions.T
    elif name in ("cosine_similarity", "cosine_distance"):
        scale = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(questions, axis=1)
        dots = vectors @ questions.T
        found = np.divide(dots, scale, out=np.full_like(dots, np.nan), where=scale > 0)
        if name == "cosine_distance":
            found = 1.0 - found
    else:
        # Differences first: expanding the square loses the digits of small distances.
        found = np.empty((len(vectors), len(questions)))
        for j, question in enumerate(questions):
            gap = vectors - question
            if name == "manhattan_distance":
                found[:, j] = np.abs(gap).sum(axis=1)
            else:
                found[:, j] = (gap * gap).sum(axis=1)
        if name == "euclidean_distance":
            found = np.sqrt(found)
    return np.round(found, SCORE_DIGITS) + 0.0


def _without_copies(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Indexes of the rows that do not repeat an earlier row of the batch in all columns."""
    content = pc.dictionary_encode(batch.column("chunk_content")).indices
    name = pc.dictionary_encode(batch.column("document_name")).indices
    content = content.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    name = name.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    key = content * (len(batch) + 1) + name
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    earlier = first[group]
    if len(first) == len(key):
        return np.arange(len(key))
    copy = (earlier != np.arange(len(key))) & (vectors == vectors[earlier]).all(axis=1)
    return np.flatnonzero(~copy)


class _Best:
    """The best ``k`` distinct (cost, content, name) of one question so far."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[float, str, str]] = []

    @property
    def limit(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else np.inf

    def offer(self, costs: np.ndarray, content: list, name: list) -> None:
        """Rows of a batch that may belong to the best; ties with the limit are compared whole."""
        within = np.flatnonzero(costs <= self.limit)
        wanted = self.k
        while True:
            pick = within
            if len(within) > wanted:
                bar = np.partition(costs[within], wanted - 1)[wanted - 1]
                pick = within[costs[within] <= bar]
            fresh = {(float(costs[i]), content[i] or "", name[i] or "") for i in pick}
            if len(fresh) >= self.k or len(pick) == len(within):
                break
            wanted *= 4
        self.rows = sorted(fresh.union(self.rows))[: self.k]


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a vector, regrouped: the fewer batches, the fewer times a best list changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch.filter(batch.column("embedding").is_valid()))
        if sum(map(len, held)) >= ROWS_PER_STEP or sum(b.nbytes for b in held) >= BYTES_PER_STEP:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _best_rows(
    batches: Iterator[pa.RecordBatch], blocks: Sequence[np.ndarray], k: int, metric: str
) -> list[list[_Best]]:
    """The best rows of each question of each block, from one pass over the batches."""
    best = [[_Best(k) for _ in range(len(questions))] for questions in blocks]
    sign = -1.0 if METRICS[metric] else 1.0
    for batch in _larger(batches):
        if not len(batch):
            continue
        vectors = _matrix(batch.column("embedding"), blocks[0].shape[1])
        rows = _without_copies(batch, vectors)
        vectors = vectors[rows]
        content = name = None
        step = max(1, CELLS_PER_STEP // len(rows))
        for questions, mine in zip(blocks, best, strict=True):
            for start in range(0, len(questions), step):
                costs = sign * _scores(metric, vectors, questions[start : start + step])
                np.nan_to_num(costs, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                limits = np.array([b.limit for b in mine[start : start + step]])
                for j in np.flatnonzero((costs <= limits).any(axis=0)):
                    if content is None:
                        content = batch.column("chunk_content").take(pa.array(rows)).to_pylist()
                        name = batch.column("document_name").take(pa.array(rows)).to_pylist()
                    mine[start + j].offer(costs[:, j], content, name)
    return best


def _hits(best: list[_Best], qids: pa.Array, metric: str) -> pa.RecordBatch:
    sign = -1.0 if METRICS[metric] else 1.0
    found = [(i, *row) for i, b in enumerate(best) for row in b.rows]
    costs = np.array([row[1] for row in found], dtype=np.float64)
    return pa.RecordBatch.from_arrays(
        [
            qids.take(pa.array([row[0] for row in found], pa.int64())),
            pa.array([row[2] for row in found], pa.string()),
            pa.array([row[3] for row in found], pa.string()),
            pa.array(sign * costs + 0.0, mask=np.isinf(costs)),
        ],
        names=["qid", "chunk_content", "document_name", "score"],
    )


# ---------------------------------------------------------------- operators


def _order(metric: str) -> list[Column]:
    """A total order: score, then text, then name, so equal scores rank the same every time."""
    score = F.col("score")
    first = score.desc_nulls_last() if METRICS[metric] else score.asc_nulls_last()
    return [first, F.col("chunk_content"), F.col("document_name")]


def _score_with_sent_questions(
    table: DataFrame, blocks: Sequence[Broadcast], k: int, metric: str, qid: T.DataType
) -> DataFrame:
    """The best rows of every task for the questions of all ``blocks`` (ids and vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [block.value for block in blocks]
        found = _best_rows(batches, [questions for _, questions in sent], k, metric)
        for (qids, _), best in zip(sent, found, strict=True):
            yield _hits(best, qids, metric)

    return table.mapInArrow(run, T.StructType([T.StructField("qid", qid), *_HIT]))


def vector_search_batch(
    table: DataFrame,
    questions: DataFrame,
    k: int = schema.TOP_K,
    metric: str = "cosine_similarity",
    strategy: str | None = None,
    model: str | None = None,
    is_customer: bool = True,
    bytes_per_block: int = BYTES_PER_BLOCK,
    bytes_per_scan: int = BYTES_PER_SCAN,
) -> DataFrame:
    """The best ``k`` distinct chunks of every question, ranked from 1.

    ``questions`` has a unique ``qid`` and an ``embedding``. They are stored once, so the model sees
    each question once, and cut by a hash into blocks of about ``bytes_per_block``, of which the
    driver holds one at a time. A scan of the table meets blocks of ``bytes_per_scan`` together; its
    hits are written before the next scan. Questions without a vector, and an empty set, have no
    rows. ``strategy`` and ``model`` should name what the table holds: scores of different ones are
    not comparable.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    seen = searchable(table, strategy, model, is_customer)
    spark = table.sparkSession
    asked = questions.select("qid", "embedding")
    qid = asked.schema["qid"].dataType
    # Kept before it is tested for nulls: a filter on a model's output would run the model twice.
    path = shared_folder(spark, "questions")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path).filter("embedding is not null")
    size = asked.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    blocks = -(-size // bytes_per_block)
    stored = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, blocks))).cast("int"))
    if blocks > 1:
        by_block = f"{path}-blocks"
        stored.repartitionByRange("block").sortWithinPartitions("block").write.parquet(by_block)
        stored = spark.read.schema(stored.schema).parquet(by_block)
    scans = max(1, bytes_per_scan // bytes_per_block)
    fetched = max(1, BYTES_PER_BLOCK // bytes_per_block)  # blocks that reach the driver together
    hits = spark.createDataFrame([], T.StructType([T.StructField("qid", qid), *_HIT]))
    for first in range(0, blocks, scans):
        sent, last = [], min(first + scans, blocks)
        for at in range(first, last, fetched):
            mine = stored.where(F.col("block").between(at, min(at + fetched, last) - 1)).toArrow()
            for block in mine.column("block").unique().to_pylist():
                part = mine.filter(pc.equal(mine.column("block"), block))
                vectors = _matrix(part.column("embedding").combine_chunks())
                sent.append(spark.sparkContext.broadcast((part.column("qid").combine_chunks(), vectors)))
        if not sent:
            continue
        found = _score_with_sent_questions(seen, sent, k, metric, qid)
        if blocks > scans:
            hit_path = shared_folder(spark, "hits")
            found.write.parquet(hit_path)
            found = spark.read.schema(found.schema).parquet(hit_path)
        hits = hits.union(found)

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*_order(metric)))
    return (
        hits.distinct()
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("qid", "rank", "chunk_content", "score", "document_name")
    )


def vector_search(
    table: DataFrame,
    question: Sequence[float],
    k: int = schema.TOP_K,
    metric: str = "cosine_similarity",
    strategy: str | None = None,
    model: str | None = None,
    is_customer: bool = True,
) -> DataFrame:
    """The best ``k`` distinct chunks for one question vector, best first."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    seen = searchable(table, strategy, model, is_customer)
    matrix = np.asarray([question], dtype=np.float64)
    sent = table.sparkSession.sparkContext.broadcast((pa.array([0], pa.int32()), matrix))
    hits = _score_with_sent_questions(seen, [sent], k, metric, T.IntegerType())
    return (
        hits.select("chunk_content", "score", "document_name")
        .distinct()
        .orderBy(*_order(metric))
        .limit(k)
    )

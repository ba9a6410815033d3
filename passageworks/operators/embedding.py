"""Embedding: a pluggable model applied to Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), False)
STRINGS_PER_SLICE = 16_384
_REUSE_KEY = ["chunk_id", "chunking_strategy", "embedding_model"]


class Embedder(Protocol):
    """A model: a name, and one vector (a row of the matrix) for each text.

    It is sent to the workers once per task, so a large model should load itself on first use.
    """

    name: str

    def encode(self, texts: pa.Array) -> np.ndarray: ...


class HashedWords:
    """Deterministic stand-in for a model: counts of hashed lower-case words, scaled to length 1.

    Splitting and lower-casing run in Arrow kernels; Python sees each distinct word of a batch once.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashed-words-{dim}"

    def encode(self, texts: pa.Array) -> np.ndarray:
        words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[ \t\n\v\f\r]+")
        owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.cast(pa.binary())
        # The bucket of a word is the first 32 bits of its MD5, modulo the dimension.
        heads = b"".join([md5(w).digest()[:4] for w in distinct.to_pylist()])
        buckets = np.frombuffer(heads, ">u4").astype(np.int64) % self.dim
        slot = buckets[codes]
        real = pc.binary_length(distinct).to_numpy(zero_copy_only=False)[codes] > 0
        cells = np.bincount(
            owner[real].astype(np.int64) * self.dim + slot[real], minlength=len(texts) * self.dim
        )
        counts = cells.reshape(len(texts), self.dim).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)


def list_rows(rows: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array and the bounds of each row within them."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def in_slices(rows: pa.ListArray, limit: int = STRINGS_PER_SLICE) -> Iterator[pa.ListArray]:
    """Consecutive parts of a batch holding about ``limit`` strings each, so memory stays flat."""
    _, bounds = list_rows(rows)
    start = 0
    while start < len(rows):
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(rows))
        yield rows.slice(start, stop - start)
        start = stop


def vectors_to_arrow(vectors: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists at the ``valid`` places, nulls at the others."""
    flat = np.ascontiguousarray(vectors, dtype=np.float32).ravel()
    ends = np.concatenate([[0], np.cumsum(valid)]) * vectors.shape[1]
    offsets = pa.array(ends.astype(np.int32), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))


def embed(text: Column, embedder: Embedder) -> Column:
    """``array<float>`` of a text column; a null text has no vector."""

    @F.arrow_udf(VECTOR)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if batch.null_count == len(batch):
                yield pa.nulls(len(batch), pa.list_(pa.float32()))
                continue
            valid = batch.is_valid().to_numpy(zero_copy_only=False)
            yield vectors_to_arrow(embedder.encode(batch.drop_null()), valid)

    return apply(text)


def embed_once(rows: DataFrame, key: list[str], embedder: Embedder, text: str = "chunk_content") -> DataFrame:
    """``rows`` with every ``embedding`` that is null made from ``text``, once for each run of ``key``.

    Give rows whose runs are whole: partitioned by ``key`` and sorted by it within partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # the key of the last row and its vector
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.StructArray.from_arrays([batch.column(k) for k in key], names=key)
            same = np.ones(batch.num_rows - 1, dtype=bool)
            for k in key:
                column = batch.column(k)
                same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, ~same])
            given = batch.column("embedding").take(pa.array(starts)).cast(pa.list_(pa.float32()))
            wanted = given.is_null().to_numpy(zero_copy_only=False)
            vectors = given.cast(pa.list_(pa.float32()))
            if keys[0] == last and wanted[0]:
                wanted[0] = False
                vectors = pa.concat_arrays([kept, vectors[1:]])
            if wanted.any():
                made = embedder.encode(batch.column(text).take(pa.array(starts[wanted])))
                full = vectors_to_arrow(made, wanted)
                vectors = pc.if_else(pa.array(wanted), full, vectors)
            last, kept = keys[-1], vectors[-1:]
            runs = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
            at = batch.schema.get_field_index("embedding")
            columns = [*batch.columns[:at], vectors.take(pa.array(runs)), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def embed_chunks(chunks: DataFrame, embedder: Embedder, date_generated: str) -> DataFrame:
    """Adds ``embedding``, ``embedding_model`` and ``date_generated`` (``yyyy-MM-dd``)."""
    return chunks.withColumns(
        {
            "embedding": embed(F.col("chunk_content"), embedder),
            "embedding_model": F.lit(embedder.name),
            "date_generated": F.to_date(F.lit(date_generated)),
        }
    )


def embed_question(question: str, embedder: Embedder) -> list[float]:
    """The vector of one question, with the precision of stored vectors."""
    return embedder.encode(pa.array([question]))[0].astype(np.float32).tolist()


def embed_questions(questions: DataFrame, embedder: Embedder, text: str = "question") -> DataFrame:
    return questions.withColumn("embedding", embed(F.col(text), embedder))


def still_to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose text has no stored vector for their strategy and model."""
    return chunks.join(stored.select(*_REUSE_KEY).distinct(), _REUSE_KEY, "left_anti")


def _known_vectors(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """One vector per wanted key: any of its copies, so no key is larger than a row.

    The stored keys meet the wanted ones first; only the vectors of matches are grouped.
    """
    found = stored.join(wanted.select(*_REUSE_KEY).distinct(), _REUSE_KEY, "left_semi")
    return found.groupBy(*_REUSE_KEY).agg(F.any_value("embedding").alias("embedding"))


def reuse_embeddings(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks joined to the vector stored for the same text, strategy and model.

    A text that fills a third of the chunks meets one row of the stored side, and the adaptive
    skew join splits its chunks over many tasks.
    """
    return chunks.join(_known_vectors(stored, chunks), _REUSE_KEY)


def embed_missing(
    chunks: DataFrame,
    stored: DataFrame,
    embedder: Embedder,
    date_generated: str,
) -> DataFrame:
    """``embed_chunks`` in which the model only sees texts that have no stored vector."""
    keyed = chunks.withColumn("embedding_model", F.lit(embedder.name))
    known = _known_vectors(stored, keyed).withColumnRenamed("embedding", "_known")
    new_text = F.when(F.col("_known").isNull(), F.col("chunk_content"))
    return (
        keyed.join(known, _REUSE_KEY, "left")
        .withColumns(
            {
                "embedding": F.coalesce("_known", embed(new_text, embedder)),
                "date_generated": F.to_date(F.lit(date_generated)),
            }
        )
        .drop("_known")
    )

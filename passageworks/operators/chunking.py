"""Documents to chunks: six strategies, all local to a row, so chunking never shuffles."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import let, sha256_hex, strip
from passageworks.operators import strategies as st
from passageworks.operators.embedding import Embedder, HashedWords, in_slices, list_rows
from passageworks.session import small_batches

SENTENCE_END = r"(?<=[.!?])\s+"
SEPARATORS = ("\n\n", "\n", " ", "")  # fixed values, tried in this order
BREAK_PERCENTILE = 0.95
DISTANCE_DIGITS = 6
BYTES_AT_ONCE = 1 << 20  # of text split at once within a batch
SENTENCES_AT_ONCE = 4096  # compared at once within a batch


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n{2,}", -1)


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def _joined_slices(items: Column, width: int, step: int, last: Column) -> Column:
    """``items[i : i + width]`` joined by a space, for i = 0, step, ... up to ``last``."""
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(step)),
        lambda i: F.array_join(F.slice(items, i + 1, width), " "),
    )


def sentence_windows(text: Column, width: int, keep_short: bool = False) -> Column:
    """All runs of ``width`` neighbouring sentences.

    A text with fewer sentences has no window; ``keep_short`` makes it one chunk instead.
    """

    def windows(found: Column) -> Column:
        short = F.array(F.array_join(found, " ")) if keep_short else F.array().cast("array<string>")
        return F.when(
            F.size(found) >= width, _joined_slices(found, width, 1, F.size(found) - width)
        ).otherwise(short)

    return let(sentences(text), windows)


def every_n_words(text: Column, n: int) -> Column:
    """Groups of ``n`` words split at single spaces, each stripped."""
    return let(
        F.split(text, " ", -1),
        lambda words: F.transform(_joined_slices(words, n, n, F.size(words) - 1), strip),
    )


def character_windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters, each ``overlap`` into the one before."""
    stride = size - overlap
    last = F.greatest(F.char_length(text) - 1 - overlap, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.substring(text, i + 1, F.lit(size))
    )


def _found_in(codes: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Where a separator occurs in an array of code points, from left to right without overlap."""
    if len(separator) == 1:
        return np.flatnonzero(codes == separator[0])
    n = len(codes) - len(separator) + 1
    hit = np.ones(max(n, 0), dtype=bool)
    for k, code in enumerate(separator):
        hit &= codes[k : k + len(hit)] == code
    at = np.flatnonzero(hit)
    if not (np.diff(at) < len(separator)).any():
        return at
    if (separator == separator[0]).all():  # within a run of its character: every len(separator)-th
        head = np.r_[True, np.diff(at) > 1]
        start = at[head][np.cumsum(head) - 1]
        return at[(at - start) % len(separator) == 0]
    kept = [int(at[0])]
    while (k := int(np.searchsorted(at, kept[-1] + len(separator)))) < len(at):
        kept.append(int(at[k]))
    return np.array(kept)


def _merged(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring pieces, as many as fit; one sorted search for each end of a span."""
    first, last = 0, len(cuts) - 1
    while first < last:
        # The first piece that no longer fits; a span has one piece at least.
        stop = max(bisect_right(cuts, cuts[first] + size) - 1, first + 1)
        if stop >= last:
            break
        yield cuts[first], cuts[stop]
        least = max(cuts[stop] - overlap, cuts[stop + 1] - size)
        first = bisect_left(cuts, least, first, stop)
    if first < last:
        yield cuts[first], cuts[last]


def split_recursively(
    text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that occurs.

    Pieces keep the separator in front of them, so a piece is a span of the text and merging
    neighbours only moves the two ends of a span. Cut positions are arrays; steps of their own
    have only chunks, and pieces that are cut again.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = [np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in separators]

    def spans(begin: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        while separators[level] and text.find(separators[level], begin, end) < 0:
            level += 1
        if separators[level]:
            at = begin + _found_in(codes[begin:end], marks[level])
        else:
            at = np.arange(begin + 1, end)
        if len(at) and at[0] == begin:
            at = at[1:]
        bounds = np.concatenate(([begin], at, [end]))
        large = np.flatnonzero(bounds[1:] - bounds[:-1] >= size).tolist() if separators[level] else []
        cuts, run = bounds.tolist(), 0
        for piece in large:
            yield from _merged(cuts[run : piece + 1], size, overlap)
            yield from spans(cuts[piece], cuts[piece + 1], level + 1)
            run = piece + 1
        yield from _merged(cuts[run:], size, overlap)

    found = (text[begin:end].strip() for begin, end in spans(0, len(text), 0)) if text else ()
    return [chunk for chunk in found if chunk]


def _text_slices(texts: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[pa.Array]:
    """Consecutive parts of a batch of about ``most`` bytes each, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def _arrays(parts: Iterable[list[list[str] | None]]) -> pa.Array:
    """The chunks of consecutive parts of a batch; Python strings are held of one part at a time."""
    kind = pa.list_(pa.string())
    made = [pa.array(part, kind) for part in parts]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def recursive_characters(text: Column, size: int, overlap: int) -> Column:
    """The greedy merge carries state along a text, so each text runs in an Arrow batch."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk size")

    def chunks(part: pa.Array) -> list[list[str] | None]:
        return [None if t is None else split_recursively(t, size, overlap) for t in part.to_pylist()]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return _arrays(map(chunks, _text_slices(texts)))

    return split(text)


def _neighbour_groups(found: list[str], bounds: np.ndarray) -> list[str]:
    """For each sentence, the text of itself and the sentences next to it in its row."""
    groups = []
    for begin, end in zip(bounds, bounds[1:]):
        for i in range(begin, end):
            groups.append(" ".join(found[max(i - 1, begin) : min(i + 2, end)]))
    return groups


def _step_distances(groups: list[str], embedder: Embedder) -> np.ndarray:
    """Cosine distance from each group to the next; 1 where a vector has no length."""
    vectors = embedder.encode(pa.array(groups, pa.string()))
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    dots = (vectors[:-1] * vectors[1:]).sum(axis=1)
    scale = lengths[:-1] * lengths[1:]
    similarity = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return np.round(1.0 - similarity, DISTANCE_DIGITS)


def _segments(rows: pa.ListArray, embedder: Embedder) -> list[list[str]]:
    flat, bounds = list_rows(rows)
    found = flat.to_pylist()
    if not found:
        return [[] for _ in range(len(rows))]
    steps = _step_distances(_neighbour_groups(found, bounds), embedder)
    chunks = []
    for begin, end in zip(bounds, bounds[1:]):
        inside = steps[begin : max(end - 1, begin)]
        cuts = [begin]
        if len(inside):
            limit = round(float(np.quantile(inside, BREAK_PERCENTILE)), 9)
            cuts.extend(begin + 1 + np.flatnonzero(inside > limit))
        cuts.append(end)
        chunks.append([" ".join(found[a:b]) for a, b in zip(cuts, cuts[1:])])
    return chunks


def semantic(text: Column, embedder: Embedder) -> Column:
    """Cut where neighbouring sentence groups lie unusually far apart within their text.

    All sentences of a batch are embedded together, in slices of bounded size.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def segments(batch: pa.Array) -> pa.Array:
        return _arrays(_segments(rows, embedder) for rows in in_slices(batch, SENTENCES_AT_ONCE))

    # A null text has no chunks, whatever else is in its batch.
    return F.when(text.isNotNull(), segments(sentences(text)))


def chunk_column(
    text: Column,
    strategy: str,
    sizes: st.ChunkSizes = st.ChunkSizes(),
    embedder: Embedder | None = None,
) -> Column:
    """``array<string>`` of the chunks of one text."""
    if strategy == st.BY_PARAGRAPH:
        return paragraphs(text)
    if strategy == st.BY_SENTENCE:
        return sentences(text)
    if strategy == st.BY_SENTENCE_WITH_SLIDING_WINDOW:
        return sentence_windows(text, sizes.sentences)
    if strategy == st.EVERY_N_WORDS:
        return every_n_words(text, sizes.words)
    if strategy == st.RECURSIVE_CHARACTER_TEXT_SPLITTING:
        return recursive_characters(text, sizes.characters, sizes.overlap)
    if strategy == st.SEMANTIC_CHUNKING:
        return semantic(text, embedder or HashedWords())
    raise ValueError(f"unknown chunking strategy {strategy!r}")


def explode_chunks(df: DataFrame, chunks: str) -> DataFrame:
    """One row per element: ``chunk_no`` from 0 and ``chunk_content``.

    The outer form with a filter behind it: before a plain explode the optimizer puts a test
    that the array is not empty, which would compute all chunks of a text a second time.
    """
    kept = [c for c in df.columns if c != chunks]
    return df.select(
        *kept, F.posexplode_outer(chunks).alias("chunk_no", "chunk_content")
    ).filter("chunk_no is not null")


def chunk_documents(
    documents: DataFrame,
    strategies: str | Sequence[str] = st.EVERY_N_WORDS,
    sizes: st.ChunkSizes = st.ChunkSizes(),
    embedder: Embedder | None = None,
    text: str = "document_text",
) -> DataFrame:
    """One row per chunk; the other columns of the document are repeated.

    Several strategies are applied in one pass over the documents. Adds ``chunking_strategy``,
    ``chunk_no`` (from 0), ``chunk_content`` and ``chunk_id``.
    """
    names = [strategies] if isinstance(strategies, str) else list(strategies)
    if {st.RECURSIVE_CHARACTER_TEXT_SPLITTING, st.SEMANTIC_CHUNKING} & set(names):
        small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c != text]
    per_strategy = [
        F.struct(
            F.lit(st.label(name, sizes)).alias("chunking_strategy"),
            chunk_column(F.col(text), name, sizes, embedder).alias("chunks"),
        )
        for name in names
    ]
    made = documents.select(*kept, F.array(*per_strategy).alias("_all")).select(
        *kept, F.explode_outer("_all").alias("_made")
    )
    flat = made.select(*kept, "_made.chunking_strategy", F.col("_made.chunks").alias("_chunks"))
    return explode_chunks(flat, "_chunks").withColumn("chunk_id", sha256_hex(F.col("chunk_content")))

"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction on the sphere: one code word for each of two halves of the coordinates,
scaled to unit length. A vector passes all filters whose direction it meets at an inner product of
``cap`` or more. The list of these is decoded from the two halves: the words of each half are
ordered by their inner product, and only pairs that can reach the cap are looked at, so the number
of filters is the square of the number of words computed. The words grow with the square root of
the vectors of a label, so that those of a filter, and the comparisons of a vector, do not grow
with the table; vectors then pass somewhat more filters, which keeps the share of pairs found.

Vectors that pass a common filter and have the same label are compared exactly, in double
precision. A pair that shares several filters is counted in the first of them only. A filter with
many vectors is cut into blocks, and pairs of blocks are tasks of their own: no group is gathered
as a whole, no list of pairs is made. Each pair of blocks gives the number of links per vector, and
the edges of a spanning forest, which suffice for the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.components import components
from passageworks.llm.store import written
from passageworks.llm.vectors import matrix, only_length, sizes_above, usable

WORDS = 100  # code words of each half at least: 10,000 filters
IN_CELL = 64  # vectors of a label and filter on average, from which on there are more words
BEST = 16  # filters that every vector passes at least with WORDS words: its best ones
GROWTH = 0.37  # power of the words by which BEST grows: 0.998 of pairs at cosine 0.93 share a filter
BLOCK = 1024  # vectors of a block


def code_words(dim: int, words: int = WORDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors for the coordinates of each half (after a rotation)."""
    rng = np.random.default_rng(seed)
    halves = []
    for size in (dim - dim // 2, dim // 2):
        w = rng.normal(size=(words, max(size, 1)))
        halves.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return halves[0], halves[1]


def rotation(dim: int, seed: int = 12) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def words_for(n: int) -> int:
    """Code words of each half for ``n`` vectors of a label."""
    return max(WORDS, math.ceil(math.sqrt(n * BEST / IN_CELL)))


def best_for(words: int) -> int:
    """Filters that every vector passes at least; a random vector passes half as many by the cap."""
    return max(BEST, math.ceil(BEST * (words / WORDS) ** GROWTH))


def cap_height(dim: int, words: int, passed: float, seed: int = 13) -> float:
    """The inner product that random directions reach with ``passed`` of the filters on average."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = code_words(dim, words)
    i, j = rng.integers(0, words, size=(2, len(x), 2000))  # some filters for each direction
    one = np.take_along_axis(x[:, : a.shape[1]] @ a.T, i, axis=1)
    both = (one + np.take_along_axis(x[:, a.shape[1] :] @ b.T, j, axis=1)) / np.sqrt(2)
    return float(np.quantile(both, 1 - min(1.0, passed / words**2)))


def list_decode(
    unit: np.ndarray, a: np.ndarray, b: np.ndarray, cap: float, best: int = BEST
) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filters that each unit vector passes, and of its ``best`` ones.

    Words of the first half are kept only if the best word of the second half can make up the cap.
    Norms of the halves differ, so the number that passes a fixed cap varies much; the best ones
    are added so that no vector passes only a few. The m best pairs of two ordered lists lie at
    places i and j with (i + 1) * (j + 1) <= m.
    """
    n, split = len(unit), a.shape[1]
    one, two = unit[:, :split] @ a.T, unit[:, split:] @ b.T
    order = np.argsort(-two, axis=1)
    ranked = np.take_along_axis(two, order, axis=1)
    need = cap * np.sqrt(2)
    row, word = np.nonzero(one + ranked[:, :1] >= need)
    rows, filters = [], []
    for k in range(b.shape[0]):  # the k-th best word, as long as any vector still reaches the cap
        hit = one[row, word] + ranked[row, k] >= need
        row, word = row[hit], word[hit]
        if not len(row):
            break
        rows.append(row), filters.append(word * b.shape[0] + order[row, k])
    first = np.argsort(-one, axis=1)
    high = np.take_along_axis(one, first, axis=1)
    i, j = np.array([
        (i, j) for i in range(min(best, len(a))) for j in range(min(best, len(b))) if (i + 1) * (j + 1) <= best
    ]).T
    sums = high[:, i] + ranked[:, j]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :best]
    rows.append(np.repeat(np.arange(n), top.shape[1]))
    filters.append((np.take_along_axis(first, i[top], axis=1) * b.shape[0] + np.take_along_axis(order, j[top], axis=1)).ravel())
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(filters)]), axis=1)
    return both[0], both[1]


def _decoded(vectors: DataFrame, dim: int, words: int) -> DataFrame:
    a, b = code_words(dim, words)
    best = best_for(words)
    cap, turn = cap_height(dim, words, best / 2), rotation(dim)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = matrix(part.column(2))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, found = list_decode(x @ turn, a, b, cap, best)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, filters], names=["id", "label", "v", "filters"])

    return vectors.mapInArrow(run, f"id bigint, label bigint, v {kind}, filters array<int>")


def _block_links(
    cell: int, ids: list[np.ndarray], xs: list[np.ndarray], passed: list[list[np.ndarray]], least: float
) -> tuple[list[np.ndarray], np.ndarray]:
    """Links of a pair of blocks (or of one block with itself) that are first found in ``cell``.

    Returns the number of links of each vector of each block, and spanning edges of the links.
    """
    own = len(ids) == 1
    x, y = xs[0], xs[-1]
    close = (x @ y.T) >= least
    if own:
        close &= np.triu(np.ones(close.shape, dtype=bool), 1)
    close &= ids[0][:, None] != ids[-1][None, :]
    if close.any():
        # Filters below this one, as columns: a pair that shares one was counted there.
        below = np.unique(np.concatenate([f[f < cell] for side in passed for f in side]))
        if len(below):
            marks = []
            for side in passed:
                m = np.zeros((len(side), len(below)), dtype=np.float32)
                for k, f in enumerate(side):
                    m[k, np.searchsorted(below, f[f < cell])] = 1
                marks.append(m)
            close &= (marks[0] @ marks[-1].T) < 0.5
    counts = [close.sum(axis=1), close.sum(axis=0)]
    if own:
        counts = [counts[0] + counts[1]]
    i, j = np.nonzero(close)
    return counts, _forest(ids[0][i], ids[-1][j])


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges from each node of a graph to the least node of its component."""
    if not len(u):
        return np.zeros((2, 0), dtype=np.int64)
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[child], nodes[root[child]]])


_OUT = "id bigint, other bigint, n bigint"


def _exact(vectors: DataFrame, vector: str) -> Column:
    """Vectors of floats stay floats until they are compared, which halves what is shuffled."""
    kind = vectors.schema[vector].dataType.simpleString()
    return F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    least: float = 0.93, words: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Per row ``id, n_links, component_id, kept`` under links of cosine ``least`` and more.

    Rows are compared within a label only; a null label, and a vector that is null, zero or not
    finite throughout, links with nothing. component_id is the least id that links reach, the row
    itself included; kept says that it is the row's own. Rows that repeat an id are one vector's
    copies: they are not compared with each other, and each is returned. Ids that are null come
    back unlinked. An empty table gives none; vectors of different length are an error. The number
    of ``words`` follows the largest label unless it is given.
    """
    good = vectors.where(F.col(id).isNotNull() & usable(vector))
    labels = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
    good = good.select(F.col(id).cast("bigint").alias("id"), labels.alias("label"), _exact(vectors, vector).alias("v"))
    good = good.where("label IS NOT NULL")
    dim = only_length(good, "v")
    every = vectors.select(F.col(id).alias(id))
    if not dim:
        links, edges = None, None
    else:
        largest = good.groupBy("label").count().agg(F.max("count")).first()[0]
        decoded = written(_decoded(good, dim, words or words_for(largest)), "filters")
        found = written(_compared(decoded, least, block), "links")
        links = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n_links"))
        edges = found.where("other IS NOT NULL")
    if links is None:
        return every.select(id, F.lit(0).cast("long").alias("n_links"), F.col(id).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    joined = every.join(links.withColumnRenamed("id", id), id, "left").join(
        components(edges, "id", "other").withColumnRenamed("node", id), id, "left"
    )
    component = F.coalesce("component", F.col(id).cast("long"))
    return joined.select(
        id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col(id), F.lit(True)).alias("kept"),
    )


def _compared(decoded: DataFrame, least: float, block: int) -> DataFrame:
    """Numbers of links (``id, null, n``) and spanning edges (``id, other, null``)."""
    each = decoded.select("id", "label", "v", "filters", F.explode("filters").alias("cell"))
    many = sizes_above(each, ["label", "cell"], block)
    dealt = each.join(many, ["label", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    # Block p meets every block q: the pair (p, q) with p <= q is a group of its own.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q")),
    )
    placed = dealt.withColumn("part", part).select("id", "v", "filters", "label", "cell", "part", F.explode(meets).alias("pair"))
    group = F.struct("label", "cell", "pair.p", "pair.q")
    # A few groups share a key, so that a call has some work; the pairs of blocks stay apart.
    placed = placed.withColumn("group", group).withColumn("bin", F.xxhash64("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            cell, pair = key[1], key[2:]
            sides = [rows] if pair[0] == pair[1] else [rows[rows["part"] == k] for k in pair]
            if sum(len(s) for s in sides) < 2 or min(len(s) for s in sides) < 1:
                continue
            ids = [s["id"].to_numpy() for s in sides]
            xs = [np.stack(s["v"].to_numpy()).astype(np.float64) for s in sides]
            xs = [x / np.abs(x).max(axis=1, keepdims=True) for x in xs]
            xs = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in xs]
            counts, edges = _block_links(cell, ids, xs, [list(s["filters"]) for s in sides], least)
            for i, n in zip(ids, counts, strict=True):
                if n.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0])], names=["id", "other", "n"]
                    )
            if edges.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edges[0]), pa.array(edges[1]), pa.nulls(edges.shape[1], pa.int64())], names=["id", "other", "n"]
                )

    columns = ["id", "v", "filters", "part", "label", "cell", F.col("pair.p").alias("p"), F.col("pair.q").alias("q")]
    sorted_ = placed.repartition("bin").sortWithinPartitions("label", "cell", "pair.p", "pair.q")
    return sorted_.select(*columns).mapInArrow(run, _OUT)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with one (label, cell, p, q), each at most two blocks long by construction."""
    held, key = [], None
    for batch in batches:
        rows = batch.to_pandas()
        keys = rows[["label", "cell", "p", "q"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(rows)), cuts):
            if not len(part):
                continue
            new = tuple(keys[part[0]].tolist())
            if key is not None and new != key:
                yield key, pd.concat(held)
                held = []
            key = new
            held.append(rows.iloc[part])
    if held:
        yield key, pd.concat(held)

"""Ranked lexical search: a trie of documents, searched branch by branch for each item.

1.  One pass counts, for every document, its terms and those that some item asks for. What remains
    of a document is a short vector of asked terms with their frequencies.
2.  Document frequencies over all rows order the terms; a vector's terms in that order are its path,
    so documents that share their most frequent terms share a way from the root (an FP-tree).
    Vectors are dealt by range of their paths, and each task turns them into tries of bounded size.
3.  A node knows, for each term below it, the greatest frequency, the least length norm m and the
    least id. They bound the score of every document below, so each item visits the branches
    depth first, most promising first, and leaves out those that cannot reach its k best so far.
4.  The best of each task are ranked by item. Results are exact, ties included.

Sibling branches of few documents share a bucket at the trie's end, whose documents are scored
exactly, all at once. Copies of a text are one path, however many there are.

Terms are runs of 0-9, A-Z, a-z and everything beyond ASCII, with A-Z lower-cased. Null and empty
texts have no terms and are in no count. Rows are documents and items are rows, ids repeated or not;
a null doc_id comes last among equal scores. Items without terms, and empty tables, give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.flat import pieces
from passageworks.llm.store import written

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
CHUNK = 1 << 20  # bytes of a text whose terms are held at once
BYTES_PER_BLOCK = 16 << 20  # text of the items that travel to the tasks together
POSTINGS = 1 << 20  # terms of the vectors that one trie holds
BUCKET = 64  # documents at the trie's end that are scored together
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text in UTF-8, in order, a bounded part of the text at a time."""
    start = 0
    while start < len(text):
        cut = _NO_TERM.search(text, min(len(text), start + CHUNK))
        stop = cut.start() if cut else len(text)
        yield _TERM.findall(text[start:stop].lower())  # of bytes, only A-Z change
        start = stop


# ---------------------------------------------------------------- vectors


_VECTOR = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def _vectors(docs: DataFrame, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """Per row the number of its terms, and number and frequency of those that items ask for."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for start, rows in pieces(batch.column(1)):
                n, terms, tfs = [], [], []
                for row in rows:
                    raw = row.as_buffer()
                    count, found = 0, Counter()
                    for part in terms_of(raw.to_pybytes() if raw is not None else b""):
                        count += len(part)
                        found.update(filter(asked.__contains__, part))
                    n.append(count)
                    terms.append([asked[t] for t in found])
                    tfs.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(rows)), pa.array(n, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(run, _VECTOR)


_PATH = "doc_id bigint, m bigint, head binary, path array<int>, tfs array<bigint>"


def _paths(vectors: DataFrame, place: np.ndarray, documents: int, terms: int) -> DataFrame:
    """Vectors with their terms in order of frequency; ``head`` is the beginning of the path."""
    sent = vectors.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            path = sent.value[batch.column(2).flatten().to_numpy()]
            order = np.lexsort((path, row))
            path, tfs = path[order], batch.column(3).flatten().to_numpy()[order]
            ends = np.r_[0, np.cumsum(sizes)]
            text = path.astype(">u4").tobytes()
            heads = [text[4 * a : 4 * min(b, a + 6)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            offsets = pa.array(ends.astype(np.int32))
            m = [50 + 50 * n * documents // terms for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(m, pa.int64()), pa.array(heads, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(path.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs)),
                ],
                names=["doc_id", "m", "head", "path", "tfs"],
            )

    return vectors.where(F.size("terms") > 0).mapInArrow(run, _PATH)


# ---------------------------------------------------------------- the trie


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Trie:
    """Documents in the order of their paths, and the nodes above them; node 0 is the root.

    A node spans the documents ``lo`` to ``hi``; its children are the nodes ``child`` to
    ``child + children``, none for a bucket. ``keys`` (node * width + term, ascending) and ``most``
    hold the greatest frequency of each term below a node.
    """

    doc: np.ndarray
    begin: np.ndarray  # of each document's terms, and the end of the last one's
    term: np.ndarray
    impact: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray
    least_m: np.ndarray
    least_doc: np.ndarray
    keys: np.ndarray
    most: np.ndarray
    width: int

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document below each of ``nodes`` can exceed."""
        wanted = nodes[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        tf = np.where(self.keys[at] == wanted, self.most[at], 0)
        return (weights * impact(tf, self.least_m[nodes][:, None])).sum(axis=1)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _grown(begin: np.ndarray, term: np.ndarray, bucket: int) -> list[list[int]]:
    """Nodes ``lo, hi, child, children, parent`` over sorted paths; branches only where they part."""
    nodes = [[0, len(begin) - 1, 0, 0, -1]]
    todo = [0]
    while todo:
        at = todo.pop()
        lo, hi = nodes[at][:2]
        if hi - lo <= bucket:
            continue
        first, last = term[begin[lo] : begin[lo + 1]], term[begin[hi - 1] : begin[hi]]
        depth = _shared(first, last)
        if depth == len(last):
            continue  # one path for all
        sizes = np.diff(begin[lo : hi + 1])
        step = np.full(hi - lo, -1)  # paths that end here come first
        longer = sizes > depth
        step[longer] = term[begin[lo:hi][longer] + depth]
        cuts = np.r_[0, np.flatnonzero(np.diff(step)) + 1, hi - lo]
        parts = [[0, int(cuts[1])]]
        for end in cuts[2:].tolist():  # neighbours of few documents share a bucket
            if end - parts[-1][0] <= bucket:
                parts[-1][1] = end
            else:
                parts.append([parts[-1][1], end])
        nodes[at][2:4] = [len(nodes), len(parts)]
        for a, b in parts:
            todo.append(len(nodes))
            nodes.append([lo + a, lo + b, 0, 0, at])
    return nodes


def build(
    doc: np.ndarray, m: np.ndarray, begin: np.ndarray, term: np.ndarray, tf: np.ndarray, bucket: int = BUCKET
) -> Trie:
    """The trie of at least one document; every document has a term, its terms ascend."""
    raw = term.astype(">u4").tobytes()
    edges = (4 * begin).tolist()
    paths = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    order = np.array(sorted(range(len(doc)), key=paths.__getitem__))
    sizes = np.diff(begin)
    moved = _ranges(begin[:-1][order], sizes[order])
    doc, m, term, tf, sizes = doc[order], m[order], term[moved].astype(np.int64), tf[moved], sizes[order]
    begin = np.r_[0, np.cumsum(sizes)]

    lo, hi, child, children, parent = np.array(_grown(begin, term, bucket)).T
    width = int(term.max()) + 1
    ends = np.flatnonzero(children == 0)
    ends = ends[np.argsort(lo[ends])]
    # Frequencies of the buckets first, then each level's from the one below.
    node_of_doc = np.repeat(ends, (hi - lo)[ends])
    keys, most = _greatest(np.repeat(node_of_doc, sizes) * width + term, tf)
    least_m = np.zeros(len(lo), dtype=np.int64)
    least_doc = np.zeros(len(lo), dtype=np.int64)
    least_m[ends] = np.minimum.reduceat(m, lo[ends])
    least_doc[ends] = np.minimum.reduceat(doc, lo[ends])
    depth = np.zeros(len(lo), dtype=np.int64)
    for at in range(1, len(lo)):  # parents come before their children
        depth[at] = depth[parent[at]] + 1
    all_keys, all_most = [keys], [most]
    for level in range(int(depth.max()), 0, -1):
        here = np.flatnonzero(depth == level)
        for values in (least_m, least_doc):
            fresh = np.full(len(lo), _NO_ID)
            np.minimum.at(fresh, parent[here], values[here])
            above = np.unique(parent[here])
            values[above] = fresh[above]
        inside = depth[keys // width] == level
        up, up_most = keys[inside], most[inside]
        up, up_most = _greatest(parent[up // width] * width + up % width, up_most)
        all_keys.append(up), all_most.append(up_most)
        keys, most = np.r_[keys[~inside], up], np.r_[most[~inside], up_most]
    keys, most = np.concatenate(all_keys), np.concatenate(all_most)
    order = np.argsort(keys)
    return Trie(
        doc, begin, term, impact(tf, np.repeat(m, sizes)), lo, hi, child, children, least_m, least_doc,
        keys[order], most[order], width,
    )


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.maximum.reduceat(values, first)


class Best:
    """The k best (score, then id) of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def may_take(self, bound: int, least_doc: int) -> bool:
        if len(self.score) < self.k:
            return bound > 0
        return bound > self.score[-1] or (bound == self.score[-1] and least_doc < self.doc[-1])

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        fits = score >= (self.score[-1] if len(self.score) == self.k else 1)
        if not fits.any():
            return
        score, doc = np.r_[self.score, score[fits]], np.r_[self.doc, doc[fits]]
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def search(trie: Trie, terms: np.ndarray, weights: np.ndarray, best: Best, dense: np.ndarray) -> int:
    """Offer to ``best`` the documents that may belong to it; the number of buckets scored.

    ``dense`` holds the item's weight of every term.
    """
    here = terms < trie.width
    terms, weights = terms[here], weights[here]
    root = np.zeros(1, dtype=np.int64)
    stack = [(int(trie.bounds(root, terms, weights)[0]), 0)]
    scored = 0
    while stack:
        bound, node = stack.pop()
        if not best.may_take(bound, trie.least_doc[node]):
            continue
        if trie.children[node]:
            below = np.arange(trie.child[node], trie.child[node] + trie.children[node])
            bounds = trie.bounds(below, terms, weights)
            promising = np.argsort(bounds, kind="stable")
            stack += [(int(bounds[i]), int(below[i])) for i in promising if bounds[i]]
            continue
        lo, hi = trie.lo[node], trie.hi[node]
        begin = trie.begin[lo : hi + 1]
        gained = dense[trie.term[begin[0] : begin[-1]]] * trie.impact[begin[0] : begin[-1]]
        best.offer(np.add.reduceat(gained, begin[:-1] - begin[0]), trie.doc[lo:hi])
        scored += 1
    return scored


# ---------------------------------------------------------------- the operator


_BEST = "item int, doc_id bigint, score bigint"


def _best(paths: DataFrame, terms: list[np.ndarray], weights: list[np.ndarray], width: int, k: int, bucket: int) -> DataFrame:
    """The k best documents of each item among those of each task."""
    sent = paths.sparkSession.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = sent.value
        best = [Best(k) for _ in terms]
        held: list[tuple[np.ndarray, ...]] = []

        def visit() -> None:
            doc, m, sizes, path, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            trie = build(doc, m, np.r_[0, np.cumsum(sizes)], path, tf, bucket)
            dense = np.zeros(width, dtype=np.int64)
            for t, w, b in zip(terms, weights, best, strict=True):
                if len(t):
                    dense[t] = w
                    search(trie, t, w, b, dense)
                    dense[t] = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).fill_null(_NO_ID).to_numpy()
            m, sizes = batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy()
            held.append((doc, m, sizes, batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= POSTINGS:
                visit()
        if held:
            visit()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.doc) for b in best])
        if len(item):
            doc = np.concatenate([b.doc for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(doc, mask=doc == _NO_ID), pa.array(np.concatenate([b.score for b in best]))],
                names=["item", "doc_id", "score"],
            )

    return paths.select("doc_id", "m", "path", "tfs").mapInArrow(run, _BEST)


def term_weights(found: dict[int, int], documents: int) -> dict[int, int]:
    return {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in found.items()}


def _block(docs: DataFrame, text: str, items: list[tuple[int | None, bytes]], k: int, bucket: int) -> DataFrame | None:
    """The ranking of a block of items, which is bounded in size."""
    spark = docs.sparkSession
    asked = [sorted({t for part in terms_of(raw) for t in part}) for _, raw in items]
    numbers = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    vectors = written(_vectors(docs, text, numbers), "vectors")
    documents, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    found = {r["t"]: r["count"] for r in counts}  # one row per asked term
    if not found:
        return None
    by_frequency = sorted(found, key=lambda t: (-found[t], t))
    place = np.full(len(numbers), -1, dtype=np.int64)
    place[by_frequency] = np.arange(len(by_frequency))
    weight = np.zeros(len(numbers), dtype=np.int64)
    for t, w in term_weights(found, documents).items():
        weight[t] = w
    item_terms, item_weights = [], []
    for a in asked:
        mine = np.array([numbers[t] for t in a], dtype=np.int64)
        mine = mine[weight[mine] > 0] if len(mine) else mine
        item_terms.append(place[mine])
        item_weights.append(weight[mine])
    postings = sum(found.values())
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-postings // POSTINGS), min(cores, -(-postings // (POSTINGS // 16))))
    paths = _paths(vectors, place, documents, terms)
    # Documents of one path, however many, are dealt over tasks by their ids.
    dealt = paths.repartitionByRange(parts, "head", F.xxhash64("doc_id", "m"))
    best = _best(dealt, item_terms, item_weights, len(by_frequency), k, bucket)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(items)], "item int, item_id bigint")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", bucket: int = BUCKET, bytes_per_block: int = BYTES_PER_BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, scores above 0 only.

    Items are cut by a hash into blocks of about ``bytes_per_block`` of text, each ranked in a pass
    of its own; rows of one id and text are ranked once each.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("t"))
    asked = asked.where("t IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // bytes_per_block)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).collect()
        rows = sorted(((r["id"], r["t"].encode()) for r in mine), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ranked = _block(docs, text, rows, k, bucket) if rows else None
        if ranked is not None:
            out = out.union(ranked)
    return out

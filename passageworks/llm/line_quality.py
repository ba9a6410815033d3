"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of bytes, lengths, repeated words and
repeated lines, taken of the line and of its two neighbours; the chain adds a weight for each pair
of labels of neighbouring lines. The field is trained on the lines of labelled documents, which
carry the label of their document. A document's raw quality is the length-weighted mean of its
lines' marginals (forward-backward); a logistic curve over it, the share of its worst lines and
the document's repetition makes that a probability.

What is fitted is bounded: at most MOST documents of each label, and of each a window of WINDOW
lines at a place chosen by hash. All lines of all texts are scored. Null and empty texts are one
empty line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from passageworks.llm import flat
from passageworks.llm.sample import labelled_sample
from passageworks.llm.store import send
from passageworks.llm.toxicity import logistic

MOST = 2000
WINDOW = 64

# Kinds of bytes whose share of a line is a feature.
_KINDS = (
    range(65, 91), range(97, 123), range(48, 58), b" \t", b".,;:'\"()-?", b"!", b"|", b"#$%&*", b"@/\\=<>_~^+[]{}",
    range(128, 256),
)
OWN = len(_KINDS) + 6  # features of a line itself


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every line; the line end belongs to no line."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break at the end of a row opens an empty line there, before the next row's first one.
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_row = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1) + 1
    row = np.repeat(np.arange(len(offsets) - 1), per_row)
    return row, start, end


def line_features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of bytes, and own features of each line of a batch."""
    data, offsets = flat.text_bytes(part)
    row, start, end = _lines(data, offsets)
    size = end - start
    whole = np.maximum(size, 1).astype(np.float64)
    out = np.zeros((len(row), OWN))
    for k, kind in enumerate(_KINDS):
        table = np.zeros(256, dtype=np.int64)
        table[list(kind)] = 1
        total = np.r_[0, np.cumsum(table[data])]
        out[:, k] = (total[end] - total[start]) / whole
    word_row, word_start, _, word = flat.words(data, offsets)
    line = np.searchsorted(start, word_start, side="right") - 1
    # Where lines start at one place, all but the last of them are empty.
    count = np.bincount(line, minlength=len(row))
    order = np.lexsort((word, line))
    new = np.r_[True, (line[order][1:] != line[order][:-1]) | (word[order][1:] != word[order][:-1])] if len(word) else np.zeros(0, bool)
    distinct = np.bincount(line[order][new], minlength=len(row))
    print_ = np.zeros(len(row), dtype=np.uint64)
    np.add.at(print_, line, word * (np.uint64(2) * (np.arange(len(word)) - np.r_[0, np.cumsum(count)][line]).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((print_, row))
    same = (row[order][1:] == row[order][:-1]) & (print_[order][1:] == print_[order][:-1]) & (count[order][1:] > 0)
    again = np.zeros(len(row), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    base = len(_KINDS)
    out[:, base] = np.log1p(size) / 10
    out[:, base + 1] = np.log1p(count) / 10
    out[:, base + 2] = np.minimum(size / np.maximum(count, 1), 40) / 10
    out[:, base + 3] = 1 - distinct / np.maximum(count, 1)
    out[:, base + 4] = again
    out[:, base + 5] = (end > start) & (data[np.minimum(end - 1, max(0, len(data) - 1))] != 46) if len(data) else 0
    return row, size, out


def with_neighbours(row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after (0 at the ends of a row)."""
    same = (row[1:] == row[:-1])[:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(unary: np.ndarray, row: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by forward-backward over the lines of each row.

    Rows are handled together, place by place; ``links`` holds the weights of label pairs.
    """
    if not len(unary):
        return unary
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[first, len(row)])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # rows longer than t
    forward = np.zeros((len(unary), 2))
    backward = np.zeros((len(unary), 2))
    for t in range(length[0]):
        at = first[: active[t]] + t
        if t:
            last = forward[at - 1]
            forward[at, 0] = np.logaddexp(last[:, 0] + links[0, 0], last[:, 1] + links[1, 0])
            forward[at, 1] = np.logaddexp(last[:, 0] + links[0, 1], last[:, 1] + links[1, 1])
            forward[at] -= forward[at].max(axis=1, keepdims=True)
        forward[at, 1] += unary[at]
    for t in range(length[0] - 2, -1, -1):
        at = first[: active[t + 1]] + t
        good = backward[at + 1, 1] + unary[at + 1]
        bad = backward[at + 1, 0]
        backward[at, 0] = np.logaddexp(bad + links[0, 0], good + links[0, 1])
        backward[at, 1] = np.logaddexp(bad + links[1, 0], good + links[1, 1])
        backward[at] -= backward[at].max(axis=1, keepdims=True)
    odds = forward + backward
    return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -40, 40)))


def _pair_marginals(unary: np.ndarray, row: np.ndarray, links: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring labels, summed over all rows.

    In a chain of two labels the pair table follows from both marginals and the odds ratio of the
    link weights, which conditioning on the rest of the chain leaves unchanged.
    """
    same = row[1:] == row[:-1]
    p, q = m[:-1][same], m[1:][same]
    ratio = np.exp(links[1, 1] + links[0, 0] - links[0, 1] - links[1, 0])
    if abs(ratio - 1) < 1e-9:
        both = p * q
    else:
        s = 1 + (p + q) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * p * q, 0))) / (2 * (ratio - 1))
    return np.array([[(1 - p - q + both).sum(), (q - both).sum()], [(p - both).sum(), both.sum()]])


def fit(features: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of label pairs, by gradient steps on the penalised likelihood.

    ``row`` numbers the documents, ``y`` holds the label of each line. Every document counts by
    the root of its length, so long ones do not drown the others.
    """
    count = np.bincount(row)
    weight = (1 / np.sqrt(np.maximum(count, 1)))[row]
    same = row[1:] == row[:-1]
    seen = np.array([[(same & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    w, links = np.zeros(features.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(links), np.zeros_like(links)]
    docs = max(1, len(count))
    for step in range(1, rounds + 1):
        unary = features @ w
        m = marginals(unary, row, links)
        g_w = features.T @ (weight * (y - m)) / docs - 1e-3 * w
        g_l = (seen - _pair_marginals(unary, row, links, m)) / max(1, same.sum()) - 0.05 * links
        for value, g, a, b in ((w, g_w, state[0], state[1]), (links, g_l, state[2], state[3])):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            value += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w, links


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    curve: np.ndarray
    intercept: float

    def summary(self, row: np.ndarray, size: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Per document: the log-odds of its raw quality, the share of bad text, its repetition."""
        good = marginals(with_neighbours(row, (own - self.mean) / self.scale) @ self.weights, row, self.links)
        weight = size + 1.0
        total = np.bincount(row, weight, n)
        total[total == 0] = 1
        mean = np.clip(np.bincount(row, weight * good, n) / total, 1e-4, 1 - 1e-4)
        bad = np.bincount(row, weight * (good < 0.5), n) / total
        repeat = np.bincount(row, weight * own[:, len(_KINDS) + 3], n) / total
        return np.c_[np.log(mean / (1 - mean)), bad, repeat]

    def score(self, part: pa.Array) -> np.ndarray:
        row, size, own = line_features(part)
        z = self.summary(row, size, own, len(part)) @ self.curve + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample_lines(sample: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in flat.pieces(batch.column(2)):
                row, size, own = line_features(part)
                ids = batch.column(0).slice(first, len(part)).to_numpy(zero_copy_only=False)
                labels = batch.column(1).slice(first, len(part))
                packed = []
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                for k in range(len(part)):
                    lo, hi = int(ends[k]), int(ends[k + 1])
                    if hi - lo > WINDOW:
                        lo += int(flat.mix(np.array([ids[k]], dtype=np.int64).view(np.uint64))[0] % np.uint64(hi - lo - WINDOW + 1))
                        hi = lo + WINDOW
                    packed.append(np.c_[size[lo:hi], own[lo:hi]].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([labels, pa.array(packed, pa.binary())], names=["y", "lines"])

    return sample.select("doc_id", "y", text).mapInArrow(run, "y int, lines binary")


def train(
    docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", most: int = MOST,
    text: str = "text",
) -> Quality:
    """The model learnt from at most ``most`` documents of each label.

    Without labelled documents every text gets 1, with a single label that label.
    """
    sample = labelled_sample(docs, labels, label, learn_from, most, text)
    rows = sorted((r[0], bytes(r[1])) for r in _sample_lines(sample, text).collect())
    y = np.array([r[0] for r in rows], dtype=np.int64)
    none = Quality(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 1), np.zeros((2, 2)), np.zeros(3), 30.0)
    if not len(y) or y.min() == y.max():
        none.intercept = -30.0 if len(y) and y[0] == 0 else 30.0
        return none
    parts = [np.frombuffer(r[1], dtype=np.float32).reshape(-1, OWN + 1) for r in rows]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    lines = np.concatenate(parts).astype(np.float64)
    size, own = lines[:, 0], lines[:, 1:]
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    w, links = fit(with_neighbours(row, (own - mean) / scale), row, y[row])
    model = Quality(mean, scale, w, links, np.zeros(3), 0.0)
    total = dict(labels.where(learn_from).groupBy(label).count().collect())
    share = np.array([total.get(k, 0) / (y == k).sum() for k in (0, 1)])
    share /= share.min()
    model.curve, model.intercept = logistic(model.summary(row, size, own, len(y)), y.astype(np.float64), share[y], ridge=0.1)
    return model


def quality(docs: DataFrame, model: Quality, text: str = "text", name: str = "score") -> DataFrame:
    """``doc_id`` and the probability ``name`` that the text is good, for every row of ``docs``."""
    sent = send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent()
        for batch in batches:
            for first, part in flat.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(learnt.score(part))],
                    names=["doc_id", name],
                )

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id bigint, {name} double")

"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

1.  Voters. Every word, and every beginning of a word of 4 to 6 bytes, that sets toxic documents
    of the sample apart becomes a lexicon voter; pattern voters test shouting, repeated marks and
    second-person address. A voter says "toxic" where it fires and abstains elsewhere; one more
    voter says "clean" where no lexicon voter fires. Support is counted over least word hashes
    instead of documents, so that a group of copies counts once.
2.  Label model. Each voter has a rate of firing among toxic and among clean documents. They start
    from the labelled rows and are fitted by expectation maximisation. Voters that fire together
    more than their rates explain are correlated; each is weighed by one over one plus the sum of
    its correlations, so a word and its beginnings count about once.
3.  Classifier. A logistic regression is trained on the posterior labels of the model, and scores
    every document by its words, in one pass over the texts without a shuffle.

What is fitted is bounded: at most MOST documents of each label and VOTERS voters. All texts are
scored whole. Null and empty texts have no votes and get the score of such a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm import flat
from passageworks.llm.sample import labelled_sample
from passageworks.llm.store import send, written

MOST = 6000  # sampled documents of each label
VOTERS = 400  # lexicon voters
SUPPORT = 5  # groups of copies in which a lexicon voter must fire
BEGINNINGS = (4, 5, 6)  # bytes
SECOND_PERSON = ("you", "your", "vous", "votre", "du", "ihr", "usted", "tu")
# Words of abuse, whose common voter fires on any of them.
ABUSE = (
    "idiot idiots idiotic moron morons moronic stupid imbecile scum trash garbage filth filthy vermin clown "
    "loser losers pathetic worthless disgusting repulsive degenerate retard retarded dumbass asshole bastard "
    "bitch whore slut shit crap fuck fucking cretin dimwit "
    "trottel vollidiot abschaum dreckskerl arschloch schwein blödmann dummkopf wichser hurensohn "
    "imbécile crétin connard connasse salaud salope ordure débile abruti merde "
    "imbécil estúpido estúpida cretino basura escoria gilipollas cabrón mierda puta pendejo"
).split()
PATTERNS = 4


def _letters() -> np.ndarray:
    """For each byte whether it belongs to a word: letters of ASCII and all bytes beyond it."""
    out = np.zeros(256, dtype=bool)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return out


_LETTER = _letters()


def _spaced(data: np.ndarray) -> np.ndarray:
    """The bytes with everything but letters as spaces."""
    return np.where(_LETTER[data], data, np.uint8(32))


def _terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of all terms of a batch (words, then beginnings); row and hash of its words."""
    data, offsets = flat.text_bytes(part)
    spaced = _spaced(data)
    row, start, end, word = flat.words(spaced, offsets)
    rows, terms = [row], [word]
    for size in BEGINNINGS:
        has = np.flatnonzero(end - start > size)
        at = start[has]
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            byte = spaced[at + k].astype(np.uint64)
            byte += np.where((byte >= 65) & (byte <= 90), np.uint64(32), np.uint64(0))
            total += flat.mix(byte + np.uint64(257 * (k + 1)))
        rows.append(row[has]), terms.append(flat.mix(total + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(terms), row, word


def _patterns(part: pa.Array, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One column per pattern voter: shouting, rows of marks, address, words of abuse."""
    data, offsets = flat.text_bytes(part)
    n = len(part)
    out = np.zeros((n, PATTERNS), dtype=bool)
    owner = np.searchsorted(offsets, np.arange(len(data)), side="right") - 1
    count = lambda hit: np.bincount(owner[hit], minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    out[:, 0] = count((data >= 65) & (data <= 90)) > 0.3 * size
    marks = (data == 33) | (data == 63)
    doubled = marks.copy()
    doubled[1:] &= marks[:-1]
    doubled[:1] = False
    out[:, 1] = count(doubled) > 0
    address = np.isin(word, _hashes(SECOND_PERSON))
    out[:, 2] = np.bincount(row[address], minlength=n) > 0.02 * np.bincount(row, minlength=n)
    out[row[np.isin(word, _hashes(ABUSE))], 3] = True
    return out


def _hashes(words: Sequence[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return flat.words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[3]


def _sample_terms(sample: DataFrame, text: str) -> DataFrame:
    """``y, least, term`` once per sampled document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in flat.pieces(batch.column(1)):
                rows, terms, row, word = _terms(part)
                least = np.full(len(part), np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, row, word)
                once = np.unique(np.stack([rows.astype(np.uint64), terms]), axis=1)
                rows, terms = once[0].astype(np.int64), once[1].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[first + rows]), pa.array(least[rows].view(np.int64)), pa.array(terms)],
                    names=["y", "least", "term"],
                )

    return sample.select("y", text).mapInArrow(run, "y int, least bigint, term bigint")


def lexicon(sample: DataFrame, text: str) -> np.ndarray:
    """The hashes of the terms that tell toxic documents apart, at most VOTERS of them."""
    counts = (
        _sample_terms(sample, text).groupBy("term", "y", "least").agg(F.lit(1).alias("one"))
        .groupBy("term").agg(
            F.sum(F.col("y")).alias("toxic"), F.sum(1 - F.col("y")).alias("clean"),
        )
        .where(F.col("toxic") >= SUPPORT)
    )
    # Odds against documents in which nothing but chance puts the term, less its own uncertainty.
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (
        counts.withColumn("sure", odds - error).where("sure > 1.5")
        .orderBy(F.desc("toxic") , F.desc("sure"), "term").limit(4 * VOTERS)
        .orderBy(F.desc(F.col("sure") + F.log(F.col("toxic"))), "term").limit(VOTERS)
    )
    return np.sort(np.array([r[0] for r in best.select("term").collect()], dtype=np.int64).view(np.uint64))


def _votes(part: pa.Array, terms: np.ndarray) -> np.ndarray:
    """Which voter fires on which row: the lexicon, the patterns, and "nothing found"."""
    rows, found, row, word = _terms(part)
    out = np.zeros((len(part), len(terms) + PATTERNS + 1), dtype=bool)
    if len(terms):
        place = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
        hit = terms[place] == found
        out[rows[hit], place[hit]] = True
    out[:, len(terms) : -1] = _patterns(part, row, word)
    out[:, -1] = ~(out[:, : len(terms)].any(axis=1) | out[:, -2])
    return out


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "toxic" of each row under the fitted model, and the weight of each voter.

    ``votes`` are rows x voters, ``y`` the labels from which the rates start.
    """
    v = votes.astype(np.float64)
    posterior = np.where(y > 0, 0.95, 0.05)
    weight = np.ones(v.shape[1])
    for _ in range(rounds):
        fire = [(w @ v + 0.5) / (w.sum() + 1.0) for w in (1 - posterior, posterior)]
        # Correlation of voters beyond what the two rates explain.
        rest = v - (np.outer(1 - posterior, fire[0]) + np.outer(posterior, fire[1]))
        cov = rest.T @ rest / max(1, len(v))
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.abs(cov / np.outer(scale, scale))
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        weight = 1 / (1 + corr.sum(axis=1))
        on = weight * np.log(fire[1] / fire[0])
        off = weight * np.log((1 - fire[1]) / (1 - fire[0]))
        prior = np.log(posterior.mean() / (1 - posterior.mean()))
        log_odds = prior + v @ on + (1 - v) @ off
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        # The labelled rows anchor the model: a label is right with probability 0.95.
        anchored = log_odds + np.where(y > 0, 1, -1) * np.log(0.95 / 0.05)
        moved, posterior = posterior, 1 / (1 + np.exp(-np.clip(anchored, -30, 30)))
        if np.abs(moved - posterior).max() < 1e-6:
            break
    return (new + posterior) / 2, weight


@dataclass
class Classifier:
    terms: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, part: pa.Array) -> np.ndarray:
        z = self.features(part) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def features(self, part: pa.Array) -> np.ndarray:
        return _votes(part, self.terms).astype(np.float64)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def train(
    docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", most: int = MOST,
    text: str = "text",
) -> Classifier:
    """The classifier learnt from at most ``most`` documents of each label.

    Without any labelled document it gives 0 for every text; a single label gives that label.
    """
    sample = written(labelled_sample(docs, labels, label, learn_from, most, text), "sample")
    terms = lexicon(sample, text)
    width = len(terms) + PATTERNS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in flat.pieces(batch.column(1)):
                packed = np.packbits(_votes(part, terms), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array([r.tobytes() for r in packed])],
                    names=["y", "votes"],
                )

    rows = sample.select("y", text).mapInArrow(run, "y int, votes binary").collect()
    if not rows:
        return Classifier(terms, np.zeros(width), -30.0)
    votes = np.unpackbits(np.frombuffer(b"".join(bytes(r[1]) for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, :width].astype(bool)
    y = np.array([r[0] for r in rows])
    if y.min() == y.max():
        return Classifier(terms, np.zeros(width), 30.0 if y[0] else -30.0)
    posterior, _ = label_model(votes, y)
    # Each sampled row stands for as many labelled rows as its label has for one of the sample.
    total = dict(labels.where(learn_from).groupBy(label).count().collect())
    share = np.array([total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return Classifier(terms, *logistic(votes.astype(np.float64), posterior, share[y] / share.min()))


def toxicity(docs: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` (double) that each text is toxic."""
    sent = send(docs.sparkSession, model)
    schema = f"doc_id bigint, {name} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent()
        for batch in batches:
            for first, part in flat.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(learnt.score(part))],
                    names=["doc_id", name],
                )

    return docs.select("doc_id", text).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    sent = send(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent()
        for batch in batches:
            for first, part in flat.pieces(batch.column(at)):
                clean = learnt.score(part) < threshold
                yield batch.slice(first, len(part)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)

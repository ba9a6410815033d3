"""Secret scans: fixed patterns, and formats inferred from what the patterns find.

1.  One pass over the texts finds the base spans, and as candidates all tokens as long as the
    shortest value that do not lie inside a base span, and counts the character classes of all that
    lies outside base spans. All of it is written as a table.
2.  The values of the base spans are labelled credentials of their kind. For each kind, a bounded
    sample of distinct values builds a prefix tree over character classes; states whose futures are
    statistically compatible (Hoeffding's bound, as in ALERGIA) are merged, which gives a
    probabilistic automaton of the format, loops included.
3.  All values are then scored. Those that no automaton of their kind explains are a format too rare
    for the sample: they are the next round's values, until none are left or too few to learn from.
    So a format with LEAST_LEARNT examples is learnt, however many other values its kind has.
4.  Every candidate is scored by its likelihood per character under each automaton, against the
    likelihood under the class frequencies of all ordinary text. Candidates at least as likely as
    nearly all learnt credentials, and no shorter or longer than these, are reported as spans of
    kind ``format``. Base spans stay as they are.

Offsets are code points, ends exclusive; a span is a whole match. Null texts are empty, and empty
texts have no spans. Without credentials there are no automata and no added spans. Long texts are
scanned whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.flat import pieces, text_bytes
from passageworks.llm.store import release, send, written

# Fixed patterns of the base kinds, in the order of their kinds, with the least length of a value.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters: shorter runs hold no longer ones
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("passw", "secret", "token", "api")
LEAST_VALUE = 12

_TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_VALUE},}}")
_CLASS = str.maketrans(
    {
        **dict.fromkeys("0123456789", "d"),
        **dict.fromkeys("abcdef", "h"),
        **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
        **dict.fromkeys("ABCDEF", "H"),
        **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"),
    }
)
SYMBOLS = "dhlHU+/_.=-"

MOST_LEARNT = 300  # distinct credentials of a kind from which an automaton is inferred; the rest is checked against it
LEAST_LEARNT = 8  # credentials without which there is no automaton
CONFIDENCE = 0.05  # of Hoeffding's bound: smaller merges more
TAIL = 0.02  # share of credentials below the threshold, which is three deviations below the mean at most
EXPLAINED = 8  # deviations below the mean down to which a value is of the automaton's format
LEAST_RATIO = math.log(1000)  # of the two likelihoods of a whole candidate
_REMEMBERED, _SHORT = 20_000, 256  # shapes of which a task remembers the answer, and their length


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                out.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Tokens of LEAST_VALUE characters and more that lie in no base span; they may hold one."""
    out, k, reach = [], 0, 0
    spans = sorted((s, e) for s, e, _, _ in taken)
    for m in _TOKEN.finditer(text):
        while k < len(spans) and spans[k][0] <= m.start():
            reach, k = max(reach, spans[k][1]), k + 1
        if reach < m.end():
            out.append((m.start(), m.end(), m[0]))
    return out


@dataclass
class Automaton:
    """States with counts of each next symbol (and of stopping); state 0 begins.

    ``least`` is the score per character from which a token counts as of this format, ``floor`` the
    one from which a credential is explained by it; ``lengths`` are those of the credentials learnt.
    """

    stops: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}])  # symbol: state, count
    least: float = 0.0
    floor: float = 0.0
    lengths: tuple[int, int] = (0, 0)

    def explains(self, shape: str) -> bool:
        return self.score(shape) / (len(shape) + 1) >= self.floor

    def score(self, shape: str) -> float:
        """Log-likelihood of a shape, unseen steps smoothed."""
        state, total = 0, 0.0
        for i, s in enumerate([*shape, ""]):
            move = self.moves[state] if state is not None else {}
            seen = sum(c for _, c in move.values()) + (self.stops[state] if state is not None else 0)
            count = (self.stops[state] if state is not None else 0) if s == "" else move.get(s, (None, 0))[1]
            total += math.log((count + 0.02) / (seen + 0.02 * (len(SYMBOLS) + 1)))
            if s:
                state = move[s][0] if s in move else None
        return total


def infer(shapes: Iterable[str], confidence: float = CONFIDENCE) -> Automaton:
    """The automaton of a bounded list of shapes, by merging compatible states of their prefix tree."""
    stops, moves = [0], [{}]
    for shape in sorted(shapes):
        state = 0
        for s in shape:
            if s not in moves[state]:
                moves[state][s] = [len(stops), 0]
                stops.append(0), moves.append({})
            moves[state][s][1] += 1
            state = moves[state][s][0]
        stops[state] += 1
    width = math.sqrt(0.5 * math.log(2 / confidence))

    def total(q: int) -> int:
        return stops[q] + sum(c for _, c in moves[q].values())

    def differ(k1: int, n1: int, k2: int, n2: int) -> bool:
        return abs(k1 / n1 - k2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n1, n2 = total(x), total(y)
            if not n1 or not n2:
                continue
            if differ(stops[x], n1, stops[y], n2):
                return False
            for s in moves[x].keys() | moves[y].keys():
                p, k1 = moves[x].get(s, (None, 0))
                q, k2 = moves[y].get(s, (None, 0))
                if differ(k1, n1, k2, n2):
                    return False
                if p is not None and q is not None and p != q:
                    todo.append((p, q))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            stops[x] += stops[y]
            for s, (q, c) in moves[y].items():
                if s in moves[x]:
                    moves[x][s][1] += c
                    todo.append((moves[x][s][0], q))
                else:
                    moves[x][s] = [q, c]

    kept = [0]
    fringe = [(0, s) for s in sorted(moves[0])]
    while fringe:
        source, s = fringe.pop(0)
        new = moves[source][s][0]
        if new in kept:
            continue
        for old in kept:
            if compatible(old, new):
                moves[source][s][0] = old
                fold(old, new)
                break
        else:
            kept.append(new)
        fringe = [(q, s) for q in kept for s in sorted(moves[q]) if moves[q][s][0] not in kept]
    place = {q: i for i, q in enumerate(kept)}
    return Automaton(
        [stops[q] for q in kept],
        [{s: (place[t], c) for s, (t, c) in moves[q].items()} for q in kept],
    )


def learnt(values: list[str]) -> Automaton | None:
    """The automaton of credentials, with its thresholds; none if they are too few."""
    shapes = [v.translate(_CLASS) for v in values]
    if len(shapes) < LEAST_LEARNT:
        return None
    # The thresholds are set on credentials that the automaton has not seen.
    half = infer(shapes[::2])
    scores = sorted(half.score(s) / (len(s) + 1) for s in shapes[1::2])
    automaton = infer(shapes)
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    automaton.least = min(scores[int(TAIL * len(scores))], mean - 3 * spread)
    automaton.floor = mean - EXPLAINED * max(spread, 0.05)
    automaton.lengths = (min(map(len, shapes)), max(map(len, shapes)))
    return automaton


@dataclass
class Formats:
    automata: list[tuple[str, Automaton]]  # of each kind, in the order of the rounds
    ordinary: dict[str, float]  # log-likelihood of each class in ordinary text
    known: dict[str, bool] = field(default_factory=dict)  # answers for the shapes seen last

    def matches(self, token: str) -> bool:
        shape = token.translate(_CLASS)
        if len(shape) > _SHORT:
            return self._fits(shape)
        if shape not in self.known:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[shape] = self._fits(shape)
        return self.known[shape]

    def _fits(self, shape: str) -> bool:
        fitting = [a for _, a in self.automata if a.lengths[0] <= len(shape) <= a.lengths[1]]
        plain = sum(self.ordinary[s] for s in shape) if fitting else 0.0
        for automaton in fitting:
            score = automaton.score(shape)
            if score / (len(shape) + 1) >= automaton.least and score - plain >= LEAST_RATIO:
                return True
        return False


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())])
_TOKENS = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_FOUND = (
    "doc_id bigint, base array<struct<start: bigint, end: bigint, kind: string, value: string>>, "
    "tokens array<struct<start: bigint, end: bigint, value: string>>, classes array<bigint>"
)


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Rows of tuples as a list column, without a Python object for each struct."""
    flat = [t for row in rows for t in row]
    columns = list(zip(*flat, strict=True)) if flat else [[] for _ in range(kind.num_fields)]
    made = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, names=[f.name for f in kind]))


def _class_numbers() -> np.ndarray:
    """For each byte the number of its class; len(SYMBOLS) for bytes that no token holds."""
    out = np.full(256, len(SYMBOLS), dtype=np.uint8)
    for code in range(128):
        c = chr(code)
        if re.fullmatch(r"[A-Za-z0-9+/_.=-]", c):
            out[code] = SYMBOLS.index(c.translate(_CLASS))
    return out


def _found(docs: DataFrame, text: str) -> DataFrame:
    numbers = _class_numbers()

    def counted(t: str, raw: bytes, spans: list[tuple[int, int, str, str]]) -> np.ndarray:
        """Characters of each class outside base spans."""
        if spans:
            outside, done = [], 0
            for s, e, _, _ in spans:
                outside.append(t[done:s])
                done = max(done, e)
            raw = "".join([*outside, t[done:]]).encode()
        return np.bincount(numbers[np.frombuffer(raw, dtype=np.uint8)], minlength=len(SYMBOLS) + 1)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, part in pieces(batch.column(1)):
                data, offsets = text_bytes(part)
                base, tokens, classes = [], [], []
                for k in range(len(part)):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    t = raw.decode()
                    spans = base_spans(t)
                    base.append(spans)
                    tokens.append(candidates(t, spans))
                    classes.append(counted(t, raw, spans))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)), _lists(base, _SPAN), _lists(tokens, _TOKENS),
                        pa.array(classes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "base", "tokens", "classes"],
                )

    return docs.select("doc_id", text).mapInArrow(run, _FOUND)


def _unexplained(values: DataFrame, automata: list[tuple[str, Automaton]]) -> DataFrame:
    """The rows of ``kind, value`` that no automaton of their kind explains."""
    sent = send(values.sparkSession, automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Automaton]] = {}
        for kind, automaton in sent():
            known.setdefault(kind, []).append(automaton)
        for batch in batches:
            left = [
                not any(a.explains(v.translate(_CLASS)) for a in known.get(kind, ()))
                for kind, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(left, pa.bool_()))

    return values.mapInArrow(run, "kind string, value string")


def learn_formats(found: DataFrame) -> Formats:
    """The formats of all credentials in ``found``, and the class frequencies of its ordinary text.

    Each round learns from at most MOST_LEARNT values of a kind, taken in the order of a hash, and
    hands on the values that it does not explain. It ends with a round that explains none.
    """
    sums = found.select(*[F.sum(F.get("classes", F.lit(i))).alias(s) for i, s in enumerate(SYMBOLS)]).first()
    seen = sum((n or 0) + 1 for n in sums)
    ordinary = {s: math.log(((n or 0) + 1) / seen) for s, n in zip(SYMBOLS, sums, strict=True)}
    spans = found.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    left = written(spans.distinct(), "credentials")
    automata: list[tuple[str, Automaton]] = []
    counts = {r["kind"]: r["count"] for r in left.groupBy("kind").count().collect()}
    open_kinds = [k for k in KINDS if counts.get(k, 0) >= LEAST_LEARNT]
    while open_kinds:
        made = []
        for kind in open_kinds:
            mine = left.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(MOST_LEARNT)
            automaton = learnt([r["value"] for r in mine.select("value").collect()])
            if automaton is not None:
                made.append((kind, automaton))
        automata += made
        left = written(_unexplained(left.where(F.col("kind").isin(open_kinds)), made), "credentials")
        after = {r["kind"]: r["count"] for r in left.groupBy("kind").count().collect()}
        open_kinds = [k for k in open_kinds if LEAST_LEARNT <= after.get(k, 0) < counts[k]]
        counts = after
    return Formats(automata, ordinary)


def spelled(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row ``doc_id``, the number of spans of each base kind, the hash of the base spans as
    text, and all ``spans`` as text (``kind:start:end``, by start, then kind, joined by commas)."""
    found = written(_found(docs, text), "secrets")
    sent = send(docs.sparkSession, learn_formats(found))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = sent()
        for batch in batches:
            rows = []
            for base, tokens in zip(batch.column(1), batch.column(2), strict=True):
                fixed = [(s["start"], s["end"], s["kind"]) for s in base.as_py()]
                added = [(t["start"], t["end"], "format") for t in tokens.as_py() if formats.matches(t["value"])]
                count = Counter(k for _, _, k in fixed)
                both = sorted(fixed + added, key=lambda s: (s[0], (*KINDS, "format").index(s[2])))
                digest = hashlib.sha256(spelled(fixed).encode()).hexdigest()
                rows.append((*(count[k] for k in KINDS), digest, spelled(both), len(added)))
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *made],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
                )

    return found.select("doc_id", "base", "tokens").mapInArrow(run, schema)


def without_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` (with a column doc_id) with every span replaced by ``mark``; all else as it is.

    Overlapping spans give one mark. Two passes: the first learns the formats from all rows.
    """
    found = written(_found(docs, text), "secrets")
    sent = send(docs.sparkSession, learn_formats(found))
    at = docs.columns.index(text)

    def clean(t: str | None, formats: Formats) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = [(s, e) for s, e, _, _ in base]
        spans += [(s, e) for s, e, v in candidates(t, base) if formats.matches(v)]
        out, done = [], 0
        for s, e in sorted(spans):
            if s >= done:
                out += [t[done:s], mark]
            done = max(done, e)
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        formats = sent()
        for batch in batches:
            for first, part in pieces(batch.column(at)):
                texts = pa.array([clean(t.as_py(), formats) for t in part], batch.schema.field(at).type)
                same = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [texts if i == at else same.column(i) for i in range(batch.num_columns)], schema=batch.schema
                )

    return docs.mapInArrow(run, docs.schema)

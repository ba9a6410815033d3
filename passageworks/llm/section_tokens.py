"""Token counts of fields and sections, by offset-mapped attribution.

A document is its fields, joined by line ends. It is encoded once, as a whole, with a byte-level
BPE vocabulary, so its tokens are those a model would see. Each token has a span of bytes; each
field, and each line of a field, is a section, and sections tile the document: a line end belongs
to the line before it. Tokens are joined to sections by interval, and a token that crosses a
boundary is counted once, by the rule given: in the section of its ``first`` byte, of its ``last``
byte, or the one with ``most`` of its bytes (of equal ones the first).

Counts of a document's sections always sum to its tokens. Null fields are empty; an empty field is
one empty section; documents without tokens have sections with 0. Texts are encoded whole. Rows
are local: nothing is shuffled, and repeated rows are counted each by itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = ("first", "last", "most")
_SCHEMA = (
    "doc_id bigint, field string, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file; bounded by its size, and sent to the tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def sections(fields: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The document's bytes; field, number within the field and start (bytes) of each section."""
    which, number, start, at = [], [], [], 0
    raw = [f.encode("utf-8", "replace") for f in fields]
    for k, data in enumerate(raw):
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        starts = np.r_[0, breaks + 1] + at
        which.append(np.full(len(starts), k)), number.append(np.arange(len(starts))), start.append(starts)
        at += len(data) + 1
    return b"\n".join(raw), np.concatenate(which), np.concatenate(number), np.concatenate(start)


def attribute(ends: np.ndarray, start: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether the token crosses a boundary.

    ``ends`` are the token's ends in bytes, ``start`` the ascending starts of the sections. Of
    sections that start at one place all but the last are empty, and own no byte.
    """
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(start, begins, side="right") - 1
    last = np.searchsorted(start, ends - 1, side="right") - 1
    cross = first != last
    if rule == "first":
        return first, cross
    if rule == "last":
        return last, cross
    owner = first.copy()
    for t in np.flatnonzero(cross).tolist():
        bounds = np.clip(np.r_[start[first[t] : last[t] + 1], ends[t]], begins[t], ends[t])
        owner[t] = first[t] + int(np.argmax(np.diff(bounds)))
    return owner, cross


def token_counts(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, fields: Sequence[str] = ("text",), rule: str = "most"
) -> DataFrame:
    """``doc_id, field, section, start, end, n_tokens, n_crossing`` of every section.

    start and end are code points of the whole document, the end exclusive.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = pa.array(list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        size = np.zeros(max(sent.value.values(), default=0) + 1, dtype=np.int64)
        for token, rank in sent.value.items():
            size[rank] = len(token)
        for batch in batches:
            held, rows = [], 0
            columns = [batch.column(k + 1) for k in range(len(fields))]
            for i in range(batch.num_rows):
                data, which, number, start = sections([c[i].as_py() or "" for c in columns])
                ids = np.array(encoding.encode_ordinary(data.decode("utf-8")), dtype=np.int64)
                owner, cross = attribute(np.cumsum(size[ids]), start, rule)
                n = np.bincount(owner, minlength=len(start))
                crossing = np.bincount(owner[cross], minlength=len(start))
                bytes_ = np.frombuffer(data, dtype=np.uint8)
                points = np.r_[0, np.cumsum((bytes_ & 0xC0) != 0x80)]
                place = points[np.r_[start, len(data)]]
                held.append((np.full(len(start), i), which, number, place[:-1], place[1:], n, crossing))
                rows += len(start)
                if rows > 100_000:
                    yield _rows(batch.column(0), names, held)
                    held, rows = [], 0
            if held:
                yield _rows(batch.column(0), names, held)

    return docs.select("doc_id", *fields).mapInArrow(run, _SCHEMA)


def _rows(ids: pa.Array, names: pa.Array, held: list[tuple]) -> pa.RecordBatch:
    row, which, number, start, end, n, crossing = (np.concatenate(c) for c in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), names.take(pa.array(which)), pa.array(number.astype(np.int32)),
         pa.array(start), pa.array(end), pa.array(n), pa.array(crossing)],
        names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
    )

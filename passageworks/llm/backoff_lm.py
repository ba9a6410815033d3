"""Language-model scores by stupid backoff, computed with n-gram tables partitioned by hash.

The score of a word after its context is count(context + word) / count(context) where the n-gram
has been counted in the corpus; otherwise ALPHA times the score of the word after one word less of
context, and at last its share of all words. A document's score is the mean logarithm over its
words.

``score_against`` scores other documents that way. A document of the corpus itself has all its
n-grams in the tables and never backs off, so in ``backoff_scores`` its logarithm is a difference of
two sums: over its longest n-grams, and over their contexts. That lets every n-gram be shuffled
once, as a hash: the distinct n-grams of documents are dealt to buckets by hash, as one row per
bucket and few megabytes of text; the task of a bucket builds the bucket's count table, joins it to the n-grams
it holds, and hands on one sum per document. Sums are added per document.

``document_scores`` also leaves a document's own counts out of the counts it is scored with, so it
backs off where no other document has an n-gram. Which length a word takes is known only when the
counts of all its n-grams are: blocks of documents are written, buckets return the counts of the
n-grams that a block sent, and a block's task scores its documents. Most n-grams lie in one block
alone, which needs no count from elsewhere. So blocks first send short fingerprints of their word
pairs, and then, as whole hashes, only the n-grams all of whose pairs another block may have too.
The table of blocks is bucketed by block, so the texts stay where they are when answers come back.

N-grams that a bounded sample of documents shows to be very common are counted beforehand and sent
to the tasks, so none of them gathers in one bucket. The number of buckets follows the number of
n-grams, so a bucket's size does not grow with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm import flat
from passageworks.llm.store import written

ORDER = 2
ALPHA = 0.4
NO_ID = -(1 << 62)  # stands for a null id inside the tasks
SAMPLED = 2000  # documents among which common n-grams are looked for
COMMON = 0.003  # share of the sampled documents in which a common n-gram occurs
MOST_SENT = 1 << 20  # repeated ids up to which their list is sent to the tasks
IN_BUCKET = 1 << 20  # n-grams of a bucket on average


def _ngrams(part: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per text: its row, distinct n-gram hashes with their sign times count, number of words.

    Each word after a full context gives +1 to the n-gram and -1 to the context; the words before
    are scored after the context there is. The first word has no context but the corpus.
    """
    for r, levels in _occurrences(part, order):
        size = len(levels[0])
        hashes, weights = [], []
        for n, own in enumerate(levels, 1):
            if not len(own):
                break
            weight = np.zeros(len(own))
            if n == order:
                weight += 1
            else:
                weight[0] += 1  # the word that ends the first n-gram has no longer context
                # Contexts: of every full n-gram, or of the first word after the first n-gram.
                weight[: max(0, size - n) if n == order - 1 else int(size > n)] -= 1
            hashes.append(own), weights.append(weight)
        if hashes:
            values, place = np.unique(np.concatenate(hashes), return_inverse=True)
            weight = np.bincount(place, np.concatenate(weights), len(values))
            yield r, values, weight, np.bincount(place, minlength=len(values)), size
        else:
            yield r, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), 0


def _occurrences(part: pa.Array, order: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per text: its row, and the hashes of its n-grams of each length, in the order of the text."""
    row, levels = _levels(part, order)
    ends = np.searchsorted(row, np.arange(len(part) + 1))
    for r in range(len(part)):
        lo, hi = int(ends[r]), int(ends[r + 1])
        yield r, [level[lo : max(lo, hi - n)] for n, level in enumerate(levels)]


def _levels(part: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each word, and the hashes of the n-grams of each length that begin at a word.

    N-grams that reach into the next text are among them.
    """
    data, offsets = flat.text_bytes(part)
    row, _, _, word = flat.words(data, offsets)
    levels = []
    for n in range(1, order + 1):
        total = np.zeros(max(0, len(word) - n + 1), dtype=np.uint64)
        for k in range(n):
            total = flat.mix(total + word[k : k + len(total)] + np.uint64(n))
        levels.append(total)
    return row, levels


def _common(docs: DataFrame, order: int, text: str) -> np.ndarray:
    """Hashes of the n-grams found in many of the sampled documents.

    The sample is SAMPLED documents in the order of a hash, of which the first 100,000 characters
    are looked at; which n-grams are called common changes cost, not results.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED)
    some = docs.join(F.broadcast(ids), "doc_id").select(F.substring(text, 1, 100_000).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in flat.pieces(batch.column(0)):
                for _, values, _, _, _ in _ngrams(part, order):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["h"])

    least = max(3, int(COMMON * SAMPLED))
    found = some.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") >= least).select("h")
    return np.sort(np.array([r[0] for r in found.collect()], dtype=np.int64).view(np.uint64))


def _counted(docs: DataFrame, common: np.ndarray, order: int, text: str) -> tuple[np.ndarray, int, int]:
    """Over all documents: the count of each common n-gram, of all words, and of all other n-grams,
    repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(common) + 2, dtype=np.int64)
        for batch in batches:
            for _, part in flat.pieces(batch.column(0)):
                row, levels = _levels(part, order)
                total[-2] += len(row)
                for n, level in enumerate(levels, 1):
                    hit, place = _find(common, level[row[: len(level)] == row[n - 1 :]])
                    total[:-2] += np.bincount(place[hit], minlength=len(common))
                    total[-1] += len(hit) - hit.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    sums = docs.select(text).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(len(common) + 2, dtype=np.int64)
    for r in sums.collect():
        out[r[0]] = r[1]
    return out[:-2], int(out[-2]), int(out[-1])


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[place] == values, place


_DEALT = "bucket bigint, docs array<bigint>, runs array<int>, h array<bigint>, n array<int>, w array<int>"
_SUMS = "doc_id bigint, words bigint, total double"
OWED = -1  # the bucket of rows that hold words and sums of common n-grams instead


def _dealt(
    docs: DataFrame, common: np.ndarray, log_count: np.ndarray, all_words: int, buckets: int, order: int, text: str
) -> DataFrame:
    """The n-grams of a few megabytes of text by bucket: hashes, and how many each document has.

    ``docs`` holds differences of ids, and ``runs`` the number of n-grams of each, so a row costs
    little more than its hashes. A document's words, and what it owes to common n-grams, are a
    row of their own kind: ``h`` holds the words, and the bits of the sum follow them.
    """
    sent = docs.sparkSession.sparkContext.broadcast((common, log_count))
    log_words = float(np.log(max(1, all_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = sent.value
        for batch in batches:
            for first, part in flat.pieces(batch.column(1)):
                ids = pc.fill_null(batch.column(0).slice(first, len(part)), NO_ID).to_numpy()
                found, owner, words, owed = [], [], [], []
                for r, values, weight, counts, size in _ngrams(part, order):
                    hit, place = _find(table, values)
                    alone = size if order == 1 else min(size, 1)  # words whose context is the corpus
                    owed.append(float((weight[hit] * logs[place[hit]]).sum()) - alone * log_words)
                    words.append(size)
                    found.append((values[~hit], counts[~hit], weight[~hit]))
                    owner.append(np.full(len(found[-1][0]), r))
                values, counts, weight = (np.concatenate(c) for c in zip(*found, strict=True))
                owner = np.concatenate(owner)
                home = (values >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[by])) + 1
                rows = [(OWED, ids, np.ones(len(ids)), np.r_[words, np.array(owed).view(np.int64)], [], [])]
                for at in np.split(by, cuts) if len(by) else []:
                    mine, runs = np.unique(owner[at], return_counts=True)
                    rows.append((int(home[at[0]]), ids[mine], runs, values[at].view(np.int64), counts[at], weight[at]))
                for lo in range(0, len(rows), 1000):
                    yield _packed(rows[lo : lo + 1000])

    return docs.select("doc_id", text).mapInArrow(run, _DEALT)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    bucket, ids, runs, h, n, w = zip(*rows, strict=True)
    steps = [np.diff(i, prepend=0) for i in ids]
    arrays = [
        pa.array(bucket, pa.int64()), _lists(steps, np.int64), _lists(runs, np.int32), _lists(h, np.int64),
        _lists(n, np.int32), _lists(w, np.int32),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "docs", "runs", "h", "n", "w"])


def _lists(values: tuple | list, kind: type) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind)))


def _scored(dealt: DataFrame) -> DataFrame:
    """Per document and task: words and the sum of signed log counts, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for at in np.split(np.arange(len(keys)), cuts):
                if not len(at):
                    continue
                if here is not None and keys[at[0]] != here:
                    yield _bucket_sums(held)
                    held = []
                here = keys[at[0]]
                held.append(batch.slice(int(at[0]), len(at)))
        if held:
            yield _bucket_sums(held)

    # What documents owe to common n-grams needs no bucket: those rows go where there is room.
    spread = F.when(F.col("bucket") == OWED, F.xxhash64("docs")).otherwise(F.col("bucket"))
    sorted_ = dealt.repartition(spread).sortWithinPartitions("bucket")
    return sorted_.mapInArrow(run, _SUMS)


def _bucket_sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    column = lambda name: rows.column(name).combine_chunks()
    steps, h = column("docs"), column("h")
    ids = np.concatenate([np.cumsum(d) for d in np.split(steps.flatten().to_numpy(), np.cumsum(steps.value_lengths())[:-1])])
    if rows.column("bucket")[0].as_py() == OWED:
        both = [x.reshape(2, -1) for x in np.split(h.flatten().to_numpy(), np.cumsum(h.value_lengths())[:-1])]
        words, total = np.concatenate(both, axis=1)
        return _sums(ids, words, total.view(np.float64))
    values, place = np.unique(h.flatten().to_numpy(), return_inverse=True)
    count = np.bincount(place, column("n").flatten().to_numpy(), len(values))
    gain = column("w").flatten().to_numpy() * np.log(np.maximum(count, 1))[place]
    owner = np.repeat(np.arange(len(ids)), column("runs").flatten().to_numpy())
    return _sums(ids, np.zeros(len(ids), dtype=np.int64), np.bincount(owner, gain, len(ids)))


def _sums(ids: np.ndarray, words: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(ids, mask=ids == NO_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(total)], names=["doc_id", "words", "total"])


def backoff_scores(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """``doc_id, n_words, score`` of every document under the model of all of them.

    Words are lower-cased in A-Z and cut at ASCII white space. Null and empty texts have no words
    and a null score. Rows that repeat a doc_id are scored together, as one document; all of them
    count in the tables. An empty table gives none; further columns are ignored.
    """
    docs = docs.select("doc_id", text)
    common = _common(docs, order, text)
    counts, all_words, rest = _counted(docs, common, order, text)
    buckets = max(1, -(-rest // IN_BUCKET))
    dealt = _dealt(docs, common, np.log(np.maximum(counts, 1)), all_words, buckets, order, text)
    return _per_document(_scored(dealt))


def _per_document(sums: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 9))
    return (
        sums.groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("total").alias("total"))
        .select("doc_id", "n_words", mean.alias("score"))
    )


_BLOCKS = "block bigint, ids array<bigint>, again array<boolean>, texts array<string>"
_SENT = "block bigint, bucket bigint, ids binary, h binary, n binary"
_SCORES = "doc_id bigint, words bigint, total double, left_out double, alone bigint"
IN_BLOCK = 1 << 22  # bytes of text of a block
IN_HOME = 1 << 23  # n-grams of a partition of the table of blocks, on average


def _blocks(docs: DataFrame, homes: int, text: str) -> DataFrame:
    """Documents in blocks, bucketed by block; ``again`` marks those whose id other rows have too."""
    repeated = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if (n := repeated.count()) == 0:
        marked = docs.select("doc_id", text, F.lit(False).alias("again"))
    else:
        other = repeated.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
        other = F.broadcast(other) if n <= MOST_SENT else other
        marked = docs.join(other, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
            "doc_id", text, F.coalesce("_again", F.lit(False)).alias("again")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in flat.pieces(batch.column(1), IN_BLOCK):
                ids = pc.fill_null(batch.column(0).slice(first, len(part)), NO_ID)
                whole = pa.array([0, len(part)], pa.int32())
                lists = [ids, batch.column(2).slice(first, len(part)), pc.fill_null(part, "").cast(pa.string())]
                name = pa.array([uuid.uuid4().int & ((1 << 62) - 1)])
                yield pa.RecordBatch.from_arrays(
                    [name, *(pa.ListArray.from_arrays(whole, x) for x in lists)], names=["block", "ids", "again", "texts"]
                )

    return written(marked.mapInArrow(run, _BLOCKS), "blocks", bucketed=(homes, "block"))


class _Block:
    """The distinct n-grams of the documents of a block, and where each of them is counted."""

    def __init__(self, ids: pa.Array, again: pa.Array, texts: pa.Array, common: np.ndarray, order: int, buckets: int):
        self.ids = ids.to_numpy()
        self.row, levels = _levels(texts.cast(pa.large_string()), order)
        ends = np.searchsorted(self.row, np.arange(len(self.ids)), side="right")
        self.left = ends[self.row] - np.arange(len(self.row))  # words of the text from each word on
        levels = [level[self.left[: len(level)] >= n] for n, level in enumerate(levels, 1)]
        row = np.concatenate([self.row[self.left >= n] for n in range(1, order + 1)])
        hashes = np.concatenate(levels)
        # Rows ascend within a length, so n-grams in the order of hashes are in the order of rows.
        by = np.argsort(hashes, kind="stable")
        hashes, row = hashes[by], row[by]
        first = _changes(hashes)
        head = first | _changes(row)
        self.values, self.owner, self.counts = hashes[head], row[head], np.diff(np.r_[np.flatnonzero(head), len(head)])
        place = (np.cumsum(first) - 1)[head]
        at = np.empty(len(by), dtype=np.int32)
        at[by] = np.cumsum(head) - 1
        self.at = np.split(at, np.cumsum([len(level) for level in levels])[:-1])
        distinct = hashes[first]
        hit, known = _find(common, distinct)
        self.hit, self.common = hit[place], known[place]
        # A bucket counts the n-grams of a block, each sent once; common ones are counted already.
        self.distinct, self.place = distinct[~hit], (np.cumsum(~hit) - 1)[place[~self.hit]]
        self.n = np.bincount(self.place, self.counts[~self.hit], len(self.distinct)).astype(np.int64)
        # What other rows of a document's id hold of them is counted in buckets of ids.
        self.again = np.flatnonzero(again.to_numpy(zero_copy_only=False).astype(bool)[self.owner])
        home = buckets + _home(flat.mix(self.ids.astype(np.int64).view(np.uint64)), buckets)[self.owner[self.again]]
        by = np.argsort(home, kind="stable")
        self.again, self.again_home = self.again[by], home[by]

    def prints(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of its pairs of words, the fingerprint of each, and which of them are new."""
        pair = np.zeros(len(self.values), dtype=bool)
        if len(self.at) > 1:
            pair[self.at[1]] = True
        pairs = np.zeros(len(self.distinct), dtype=bool)
        pairs[self.place[pair[~self.hit]]] = True
        prints = _prints(self.distinct[pairs], width)
        return np.flatnonzero(pairs), prints, _changes(prints)

    def asked(self, pairs: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """The places of the n-grams that other blocks may have: those without a pair of words
        that no other block has. ``elsewhere`` says it of ``pairs``."""
        shared = np.zeros(len(self.distinct), dtype=bool)
        shared[pairs[elsewhere]] = True
        may = self.hit.copy()
        may[~self.hit] = shared[self.place]
        wanted = np.zeros(len(self.values), dtype=bool)
        wanted[self.at[0]] = True
        here = np.ones(len(self.row), dtype=bool)
        for n, at in enumerate(self.at[1:], 2):
            if n == 2:
                pair = np.zeros(len(self.row), dtype=bool)
                pair[self.left >= 2] = may[at]
            here[: len(here) - n + 2] &= pair[n - 2 :]
            wanted[at[here[self.left >= n]]] = True
        found = np.zeros(len(self.distinct), dtype=bool)
        found[self.place[wanted[~self.hit]]] = True
        return np.flatnonzero(found)


def _changes(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before; the first does."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _pairs(texts: pa.Array, common: np.ndarray, order: int, width: int) -> np.ndarray:
    """The distinct fingerprints, ascending, of the pairs of words of some texts but common ones."""
    if order == 1:
        return np.zeros(0, np.uint64)
    row, (_, pair) = _levels(texts.cast(pa.large_string()), 2)
    pair = np.sort(pair[row[:-1] == row[1:]])
    pair = pair[_changes(pair)]
    prints = _prints(pair[~_find(common, pair)[0]], width)
    return prints[_changes(prints)]


def _prints(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> np.uint64(64 - width)


def _home(values: np.ndarray, buckets: int, width: int = 64) -> np.ndarray:
    """The bucket of numbers of ``width`` bits: each has one range of them, so order is kept."""
    top = min(width, 32)
    return ((values >> np.uint64(width - top)) * np.uint64(buckets) >> np.uint64(top)).astype(np.int64)


def _runs(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each run of equal keys."""
    return np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []


def _packed_numbers(values: np.ndarray) -> bytes:
    """Whole numbers by byte, the lowest bytes of all of them first: bytes that are mostly zero
    cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    planes = pa.decompress(data[4:], 8 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, size).T).view("<i8").ravel()


def _packed_steps(values: np.ndarray) -> bytes:
    """Whole numbers as differences, which are small if the numbers ascend; they wrap around."""
    return _packed_numbers(np.diff(values.view(np.int64), prepend=np.int64(0)))


def _steps(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


def _sent_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "bucket": pa.int64(), "ids": pa.binary(), "h": pa.binary(), "n": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(x) for r in rows], kinds[x]) for x in kinds], names=list(kinds))


def _by_bucket(answer: Callable[[int, pa.Table], list[dict]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The answers to the rows of each bucket, of which a task gets one after the other."""

    def answers(key: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = answer(key, pa.Table.from_batches(held))
        for lo in range(0, len(rows), 1000):
            yield _sent_batch(rows[lo : lo + 1000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for at in _runs(keys):
                if here is not None and keys[at[0]] != here:
                    yield from answers(here, held)
                    held = []
                here = int(keys[at[0]])
                held.append(batch.slice(int(at[0]), len(at)))
        if held:
            yield from answers(here, held)

    return run


def _elsewhere(key: int, rows: pa.Table) -> list[dict]:
    """Which fingerprints of each row of a bucket other blocks have too, as bits."""
    lists = [_steps(x.as_py()) for x in rows.column("h")]
    _, place, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    each = np.split(n[place] > 1, np.cumsum([len(x) for x in lists])[:-1])
    # Buckets of fingerprints count from -1 downwards, so that they are told from those of hashes.
    return [
        {"block": block, "bucket": -1 - key, "n": np.packbits(bits).tobytes()}
        for block, bits in zip(rows.column("block").to_pylist(), each, strict=True)
    ]


def _counts_elsewhere(key: int, rows: pa.Table) -> list[dict]:
    """How often the n-grams of each row of a bucket lie elsewhere: in other blocks or, with ids,
    in other rows of the same document."""
    lists = [_steps(x.as_py()) for x in rows.column("h")]
    n = np.concatenate([_numbers(x.as_py()) for x in rows.column("n")])
    values, place = np.unique(np.concatenate(lists), return_inverse=True)
    if rows.column("ids")[0].is_valid:
        ids = np.concatenate([_steps(x.as_py()) for x in rows.column("ids")])
        _, doc = np.unique(ids, return_inverse=True)
        _, place = np.unique(doc.astype(np.int64) * len(values) + place, return_inverse=True)
    more = np.bincount(place, n).astype(np.int64)[place] - n
    each = np.split(more, np.cumsum([len(x) for x in lists])[:-1])
    return [
        {"block": block, "bucket": key, "n": _packed_numbers(m)}
        for block, m in zip(rows.column("block").to_pylist(), each, strict=True)
    ]


def document_scores(
    docs: DataFrame, order: int = 3, own_order: int = ORDER, text: str = "text", alpha: float = ALPHA
) -> DataFrame:
    """``doc_id, n_words, score, left_out`` of every document.

    ``score`` is that of ``backoff_scores`` of order ``own_order``. ``left_out`` is the score of
    order ``order`` under the counts of all other documents (count minus own): a word takes the
    longest n-gram ending at it that another document has, and ``alpha`` for each word of context
    given up; a word of no other document scores as if counted once. Rows that repeat a doc_id are
    one document.
    """
    docs = docs.select("doc_id", text)
    order, keep = max(order, own_order), order
    common = _common(docs, order, text)
    counts, all_words, rest = _counted(docs, common, order, text)
    buckets = max(1, -(-rest // IN_BUCKET))
    width = rest.bit_length() + 2  # bits of a fingerprint: fewer than one in four is another's by chance
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(docs, max(1, -(-rest // IN_HOME), min(cores, -(-rest // IN_BUCKET))), text)
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _ = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                prints = _pairs(batch.column(3)[i].values, common, order, width)
                home, name = _home(prints, buckets, width), batch.column(0)[i].as_py()
                rows = [{"block": name, "bucket": int(home[at[0]]), "h": _packed_steps(prints[at])} for at in _runs(home)]
                for lo in range(0, len(rows), 1000):
                    yield _sent_batch(rows[lo : lo + 1000])

    def opened(texts: pa.Table, answers: pa.Table) -> tuple[_Block, np.ndarray]:
        """A block, and the places of the n-grams that it sends."""
        known, lists = shared.value[0], [texts.column(c)[0].values for c in (1, 2, 3)]
        block = _Block(*lists, known, order, buckets)
        pairs, prints, new = block.prints(width)
        given = _given(answers, -buckets, -1, descending=True)
        sizes = [len(at) for at in _runs(_home(prints[new], buckets, width))]
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(given, sizes, strict=True)]
        elsewhere = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        return block, block.asked(pairs, elsewhere[np.cumsum(new) - 1])

    def deal(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, asked = opened(texts, answers)
        name, rows = texts.column(0)[0].as_py(), []
        home = _home(block.distinct[asked], buckets)
        for at in _runs(home):
            entry = asked[at]
            rows.append({
                "block": name, "bucket": int(home[at[0]]), "h": _packed_steps(block.distinct[entry]),
                "n": _packed_numbers(block.n[entry]),
            })
        for at in _runs(block.again_home):
            entry = block.again[at]
            rows.append({
                "block": name, "bucket": int(block.again_home[at[0]]), "ids": _packed_steps(block.ids[block.owner[entry]]),
                "h": _packed_steps(block.values[entry]), "n": _packed_numbers(block.counts[entry]),
            })
        return pa.Table.from_batches([_sent_batch(rows)])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, asked = opened(texts, answers)
        more = [_numbers(x) for x in _given(answers, 0, buckets - 1)]
        own = [_numbers(x) for x in _given(answers, buckets, 2 * buckets - 1)]
        return pa.Table.from_batches([_block_scores(block, asked, more, own, shared.value[1], keep, own_order, alpha)])

    def counted(sent: DataFrame, answer: Callable[[int, pa.Table], list[dict]]) -> DataFrame:
        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(answer), _SENT)

    def at_blocks(answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    found = written(counted(blocks.mapInArrow(ask, _SENT), _elsewhere), "elsewhere")
    more = counted(at_blocks(found, deal, _SENT), _counts_elsewhere)
    sums = at_blocks(found.union(more), score, _SCORES)
    n = F.col("n_words")
    log_words = float(np.log(max(1, all_words)))
    others = F.log(F.greatest(F.lit(1), F.lit(all_words) - n).cast("double"))
    return (
        sums.groupBy("doc_id")
        .agg(F.sum("words").alias("n_words"), *(F.sum(x).alias(x) for x in ("total", "left_out", "alone")),
             F.sum(F.col("words") if own_order == 1 else F.least("words", F.lit(1))).alias("first"))
        .select(
            "doc_id", "n_words", F.when(n > 0, F.round((F.col("total") - F.col("first") * log_words) / n, 9)).alias("score"),
            F.when(n > 0, F.round((F.col("left_out") - F.col("alone") * others) / n, 9)).alias("left_out"),
        )
    )


def _given(answers: pa.Table, least: int, most: int, descending: bool = False) -> list[bytes]:
    """What the buckets of a range answered to a block, in their order."""
    both = zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), strict=True)
    return [n for _, n in sorted((x for x in both if least <= x[0] <= most), reverse=descending)]


def _block_scores(
    block: _Block, asked: np.ndarray, more: list, own: list, known: np.ndarray, order: int, own_order: int, alpha: float
) -> pa.RecordBatch:
    count, mine = np.zeros(len(block.values), dtype=np.int64), block.counts.astype(np.int64)
    count[block.hit] = known[block.common[block.hit]]
    total = block.n.copy()
    if more:
        total[asked] += np.concatenate(more)
    count[~block.hit] = total[block.place]
    if own:
        mine[block.again] += np.concatenate(own)
    rest = count - mine
    every, left = np.log(np.maximum(count, 1)), np.log(np.maximum(rest, 1))
    size = np.bincount(block.row, minlength=len(block.ids))
    place = np.arange(len(block.row)) - (np.cumsum(size) - size)[block.row]  # of a word in its text
    at = [np.zeros(len(block.row), dtype=np.int32) for _ in block.at]
    for k, mine in enumerate(block.at, 1):
        at[k - 1][block.left >= k] = mine
    inner, outer, chosen = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(block.row), dtype=bool)
    for k in range(1, own_order + 1):
        begin = np.flatnonzero((block.left >= k) & ((k == own_order) | (place == 0)))
        gain = every[at[k - 1][begin]] - (every[at[k - 2][begin]] if k > 1 else 0)
        inner += np.bincount(block.row[begin], gain, len(size))
    for k in range(order, 0, -1):
        begin = np.flatnonzero(block.left >= k)
        begin = begin[~chosen[begin + k - 1] & ((rest[at[k - 1][begin]] > 0) | (k == 1))]
        end = begin + k - 1
        gain = left[at[k - 1][begin]] - (left[at[k - 2][begin]] if k > 1 else 0)
        gain += (np.minimum(place[end] + 1, order) - k) * float(np.log(alpha))
        outer += np.bincount(block.row[begin], gain, len(size))
        chosen[end] = True
    alone = np.bincount(block.row[begin], minlength=len(size))  # words that are left to themselves
    ids = pa.array(block.ids, mask=block.ids == NO_ID)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(size, pa.int64()), pa.array(inner, pa.float64()), pa.array(outer, pa.float64()), pa.array(alone, pa.int64())],
        names=["doc_id", "words", "total", "left_out", "alone"],
    )


def _exploded(docs: DataFrame, order: int, text: str) -> DataFrame:
    """``doc_id, place, level, h, context``: the n-grams that end at each word, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in flat.pieces(batch.column(1)):
                data, offsets = flat.text_bytes(part)
                row, _, _, word = flat.words(data, offsets)
                before = np.zeros(0, dtype=np.uint64)
                for n in range(1, order + 1):
                    total = np.zeros(max(0, len(word) - n + 1), dtype=np.uint64)
                    for k in range(n):
                        total = flat.mix(total + word[k : k + len(total)] + np.uint64(n))
                    whole = row[: len(total)] == row[n - 1 :] if len(total) else np.zeros(0, dtype=bool)
                    context = before[: len(total)].view(np.int64)[whole] if n > 1 else np.zeros(whole.sum(), dtype=np.int64)
                    before = total
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(part)).take(pa.array(row[: len(total)][whole])),
                         pa.array(np.flatnonzero(whole) + n - 1), pa.array(np.full(whole.sum(), n, dtype=np.int32)),
                         pa.array(total[whole].view(np.int64)), pa.array(context)],
                        names=["doc_id", "place", "level", "h", "context"],
                    )

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, place bigint, level int, h bigint, context bigint")


def ngram_counts(corpus: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """``h, level, c``: the count table of all n-grams of a corpus up to ``order`` words."""
    return _exploded(corpus, order, text).groupBy("h", "level").agg(F.count(F.lit(1)).alias("c"))


def score_against(
    docs: DataFrame, counts: DataFrame, order: int = ORDER, text: str = "text", alpha: float = ALPHA
) -> DataFrame:
    """``doc_id, n_words, score`` of documents that are not of the corpus of ``counts``.

    Every word takes the longest n-gram ending at it that has been counted, and ``alpha`` for each
    word of context given up; a word never counted scores as if counted once. Ids must differ.
    """
    counts = counts.select(F.col("h"), F.col("level"), F.col("c"))
    all_words = counts.where("level = 1").agg(F.sum("c")).first()[0] or 1
    each = _exploded(docs, order, text)
    context = counts.select(F.col("h").alias("context"), (F.col("level") + 1).alias("level"), F.col("c").alias("of"))
    found = each.join(counts, ["h", "level"], "left").join(context, ["context", "level"], "left")
    of = F.when(F.col("level") == 1, F.lit(all_words)).otherwise(F.col("of"))
    own = F.when(F.col("level") == 1, F.coalesce("c", F.lit(1))).otherwise(F.col("c"))
    best = found.where((F.col("level") == 1) | F.col("c").isNotNull()).withColumn("s", F.log(own / of))
    # The longest n-gram in the document that could have been used, and the longest one found.
    longest = each.groupBy("doc_id", "place").agg(F.max("level").alias("possible"))
    chosen = best.groupBy("doc_id", "place").agg(F.max(F.struct("level", "s")).alias("b")).join(longest, ["doc_id", "place"])
    given_up = (F.col("possible") - F.col("b.level")) * F.lit(float(np.log(alpha)))
    sums = chosen.select("doc_id", F.lit(1).alias("words"), (F.col("b.s") + given_up).alias("total"))
    none = docs.select("doc_id", F.lit(0).alias("words"), F.lit(0.0).alias("total"))
    return _per_document(sums.union(none))

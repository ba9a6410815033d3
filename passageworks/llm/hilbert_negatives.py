"""Hard negatives: blocks of candidates along a Hilbert curve, read only where bounds allow.

1.  Components become integers. The rows are ordered along a Hilbert curve through the dimensions of
    greatest spread and cut into blocks. A block is one row of a Parquet table: ids, labels and
    components, with the least and greatest value of each dimension (its zone map) in columns of
    their own. Equal keys are dealt over tasks by id, so copies never meet in one task.
2.  Anchors travel in tiles, neighbours on the curve together. What an anchor asks for is a window of
    scores. First: at least the score that its own block already offers, for its positives. Then, for
    each positive, the window of scores that a hard negative may have.
3.  Only the zone maps are read to bound, by interval arithmetic, the inner products of an anchor with
    all rows of a block. A block is read for a tile if some window of it may be met there.
4.  Blocks meet a tile in groups, the most promising first; the k best of a window so far raise its
    lower end, so that blocks read later are passed over by the same bounds. Only the best of each
    group are shuffled, and ranked.

The result is exact, ties included. All arithmetic is on 64-bit integers, or on doubles where every
sum is below 2^53; larger products than 2^56 are an error, as are vectors of different length.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that
repeat an id count as one, that of the least label and components. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.store import written
from passageworks.llm.vectors import only_length

ROWS_PER_BLOCK = 1024
BLOCKS_PER_SHELF = 8  # blocks that meet a tile in one group
ANCHORS_PER_TILE = 1024
CURVE_DIMS, CURVE_BITS = 8, 4  # dimensions of the curve, and the logarithm of its cells in each
CELLS = 4 << 20  # scores held at once
_NONE, _ALL = -(1 << 62), 1 << 62  # windows without an end


def finite(column: str) -> Column:
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


# ---------------------------------------------------------------- inside a task


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers below 2^bits.

    Skilling's method: undo the turns of the sub-cubes from the largest to the smallest, then read
    the bits of all dimensions in Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    side = top
    while side > 1:
        for i in range(len(x)):
            high = (x[i] & side) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & (side - 1))
            x[0] ^= np.where(high, side - 1, swapped)
            x[i] ^= swapped
        side >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], dtype=np.int64)
    side = top
    while side > 1:
        turned ^= np.where((x[-1] & side) != 0, side - 1, 0)
        side >>= 1
    x ^= turned
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> bit) & 1)
    return key


def interval(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``x`` with any vector between the rows of
    ``low`` and ``high``: one row per vector, one column per block."""
    over, under = np.maximum(x, 0), np.minimum(x, 0)
    return over @ low.T + under @ high.T, over @ high.T + under @ low.T


def _others(kinds: list, labels: np.ndarray, same: bool) -> np.ndarray:
    """Whether a block with these labels holds rows for anchors of ``labels``."""
    return np.isin(labels, kinds) if same else np.array([len(kinds) > 1]) | (labels != kinds[0])


class Asked:
    """The windows of a tile and the best found for each: at most ``k`` by score, then id."""

    def __init__(self, tile: dict, dim: int, stored: str, work: type, k: int, same: bool):
        self.k, self.same, self.work = k, same, work
        self.x = np.frombuffer(tile["q"], stored).reshape(-1, dim).astype(work)
        self.ids = np.array(tile["ids"], dtype=np.int64)
        self.labels = np.array(tile["labels"], dtype=np.int64)
        self.at = np.array(tile["at"], dtype=np.int64)
        self.key, self.mark = tile["key"], tile["mark"]
        self.low = np.array(tile["low"], dtype=np.int64)
        self.high = np.array(tile["high"], dtype=np.int64)
        self.found = np.zeros((3, 0), dtype=np.int64)  # window, score, id

    def meet(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        """Compare with a block; the number of windows that had to."""
        least, most = interval(self.x, low[None].astype(self.work), high[None].astype(self.work))
        needed = (most[self.at, 0] >= self.low) & (least[self.at, 0] <= self.high)
        windows = np.flatnonzero(needed & _others(np.unique(labels).tolist(), self.labels[self.at], self.same))
        step = max(1, CELLS // len(ids))
        for start in range(0, len(windows), step):
            w = windows[start : start + step]
            rows, place = np.unique(self.at[w], return_inverse=True)
            scores = (self.x[rows] @ q.T).astype(np.int64)[place]
            fits = (scores >= self.low[w, None]) & (scores <= self.high[w, None])
            fits &= (labels == self.labels[self.at[w], None]) == self.same
            fits &= ids != self.ids[self.at[w], None]
            i, j = np.nonzero(fits)
            if len(i):
                self._add(np.stack([w[i], scores[i, j], ids[j]]))
        return len(windows)

    def _add(self, found: np.ndarray) -> None:
        found = np.concatenate([self.found, found], axis=1)
        found = found[:, np.lexsort((found[2], -found[1], found[0]))]
        head = np.flatnonzero(np.r_[True, found[0, 1:] != found[0, :-1]])
        rank = np.arange(found.shape[1]) - np.repeat(head, np.diff(np.r_[head, found.shape[1]]))
        self.found = found[:, rank < self.k]
        last = found[:, rank == self.k - 1]
        self.low[last[0]] = np.maximum(self.low[last[0]], last[1])

    def rows(self) -> pa.RecordBatch:
        window, score, ids = self.found
        taken = lambda values: pa.array(values, pa.int64()).take(pa.array(window))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.at[window]]), taken(self.key), taken(self.mark), pa.array(ids), pa.array(score)],
            names=["anchor_id", "key", "mark", "vec_id", "score"],
        )


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    width = rows.shape[1] * rows.itemsize
    ends = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows))])


def _number(counter: int) -> int:
    """A number that no other task gives."""
    return TaskContext.get().partitionId() << 32 | counter


# ---------------------------------------------------------------- blocks


def _statistics(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Number of rows, mean and spread of each dimension, and the greatest magnitude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, most = 0, np.zeros(dim), np.zeros(dim), np.zeros(dim)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
                most = np.maximum(most, np.abs(x).max(axis=0))
        if n:
            columns = [np.arange(dim, dtype=np.int32), np.full(dim, n), sums, squares, most]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "s", "ss", "most"])

    found = rows.select("v").mapInArrow(run, "d int, n bigint, s double, ss double, most double")
    total = found.groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.max("most")).orderBy("d").collect()
    n = total[0][1]
    mean = np.array([r[2] for r in total]) / n
    spread = np.sqrt(np.maximum(np.array([r[3] for r in total]) / n - mean * mean, 0))
    return n, mean, spread, int(max(r[4] for r in total))


_BLOCK = (
    "block bigint, ids array<bigint>, labels array<bigint>, q binary, low array<bigint>, high array<bigint>, "
    "kinds array<bigint>, asking array<int>, least array<bigint>"
)


def hilbert_blocks(
    rows: DataFrame, dim: int, n: int, mean: np.ndarray, spread: np.ndarray, stored: str, work: type, positives: int,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``rows`` (``id, label, asks, v``) as blocks in the order of the curve, not yet written.

    ``asking`` are the places of anchors within a block, ``least`` the score of the last of as many
    positives as wanted that the block itself holds; null if it holds fewer.
    """
    axes = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
    cells = 1 << CURVE_BITS
    width = np.maximum(spread[axes], 1e-9) * 4 / cells  # two deviations to either side of the mean

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy().reshape(-1, dim)
                cell = np.floor((x[:, axes] - mean[axes]) / width) + cells // 2
                place = hilbert(np.clip(cell, 0, cells - 1), CURVE_BITS)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(place), _binary(x.astype(stored))], names=["id", "label", "asks", "h", "q"]
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, counter = [], 0, 0

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal counter
            ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
            q = np.frombuffer(b"".join(part["q"].to_pylist()), stored).reshape(-1, dim)
            asking = np.flatnonzero(part["asks"].to_numpy())
            scores = (q[asking].astype(work) @ q.T.astype(work)).astype(np.int64)
            least = []
            for i, row in zip(asking, scores, strict=True):
                mine = row[(labels == labels[i]) & (ids != ids[i])]
                least.append(int(-np.sort(-mine)[positives - 1]) if len(mine) >= positives else None)
            counter += 1
            made = {
                "block": [_number(counter - 1)], "ids": [ids], "labels": [labels], "q": [q.tobytes()],
                "low": [q.min(axis=0).astype(np.int64)], "high": [q.max(axis=0).astype(np.int64)],
                "kinds": [np.unique(labels)], "asking": [asking.astype(np.int32)], "least": [least],
            }
            return pa.RecordBatch.from_pydict(
                made,
                pa.schema(
                    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("q", pa.binary()),
                     ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())),
                     ("asking", pa.list_(pa.int32())), ("least", pa.list_(pa.int64()))]
                ),
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= rows_per_block:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows_per_block))
                rest = table.slice(rows_per_block)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield block(pa.Table.from_batches(held))

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // (64 * rows_per_block)), min(cores, -(-n // rows_per_block)))
    placed = rows.select("id", "label", "asks", "v").mapInArrow(
        keyed, "id bigint, label bigint, asks boolean, h bigint, q binary"
    )
    dealt = placed.repartitionByRange(parts, "h", F.xxhash64("id")).sortWithinPartitions("h", "id")
    return dealt.select("id", "label", "asks", "q").mapInArrow(packed, _BLOCK)


_TILE = (
    "tile bigint, ids array<bigint>, labels array<bigint>, q binary, at array<int>, key array<bigint>, "
    "mark array<bigint>, low array<bigint>, high array<bigint>"
)


def _tiles(blocks: DataFrame, dim: int, stored: str, most: int = ANCHORS_PER_TILE) -> DataFrame:
    """Anchors in tiles, each with one window: any score from the own block's ``least`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, least, counter = [], [], [], [], 0

        def tile(n: int) -> pa.RecordBatch:
            nonlocal counter
            counter += 1
            part = [x[:n] for x in (ids, labels, q, least)]
            for x in (ids, labels, q, least):
                del x[:n]
            big, size = pa.list_(pa.int64()), len(part[0])
            low = [_NONE if x is None else x for x in part[3]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([_number(counter - 1)]), pa.array([part[0]], big), pa.array([part[1]], big), pa.array([b"".join(part[2])], pa.binary()),
                    pa.array([list(range(size))], pa.list_(pa.int32())), pa.array([[None] * size], big),
                    pa.array([[None] * size], big), pa.array([low], big), pa.array([[_ALL] * size], big),
                ],
                names=["tile", "ids", "labels", "q", "at", "key", "mark", "low", "high"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["q"], stored).reshape(-1, dim)
                for at, bound in zip(row["asking"], row["least"], strict=True):
                    ids.append(row["ids"][at]), labels.append(row["labels"][at]), q.append(x[at].tobytes()), least.append(bound)
            while len(ids) >= most:
                yield tile(most)
        if ids:
            yield tile(len(ids))

    asking = blocks.where(F.size("asking") > 0).select("ids", "labels", "q", "asking", "least")
    return asking.mapInArrow(run, _TILE)


_SHELF = "shelf bigint, blocks array<bigint>, kinds array<array<bigint>>, low binary, high binary"


def _shelves(blocks: DataFrame, size: int = BLOCKS_PER_SHELF) -> DataFrame:
    """The zone maps of neighbouring blocks together; of the table only their columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counter = [], 0

        def shelf(part: list[dict]) -> pa.RecordBatch:
            nonlocal counter
            counter += 1
            zone = {side: np.array([r[side] for r in part], dtype=np.int64).tobytes() for side in ("low", "high")}
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([_number(counter - 1)]), pa.array([[r["block"] for r in part]], pa.list_(pa.int64())),
                    pa.array([[r["kinds"] for r in part]], pa.list_(pa.list_(pa.int64()))),
                    pa.array([zone["low"]], pa.binary()), pa.array([zone["high"]], pa.binary()),
                ],
                names=["shelf", "blocks", "kinds", "low", "high"],
            )

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= size:
                yield shelf(held[:size])
                held = held[size:]
        if held:
            yield shelf(held)

    return blocks.select("block", "kinds", "low", "high").mapInArrow(run, _SHELF)


# ---------------------------------------------------------------- reading what bounds allow


def blocks_to_read(shelves: DataFrame, tiles: DataFrame, groups: int, dim: int, stored: str, work: type, same: bool) -> DataFrame:
    """``tile, shelf, block, best``: the blocks in which some window of a tile may be met.

    Every shelf of zone maps meets every tile once: tiles are dealt over ``groups`` numbers, and a
    shelf is repeated for each. ``best`` is the greatest score that the block may hold for the tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = Asked(row | {"low": row["w_low"], "high": row["w_high"]}, dim, stored, work, 1, same)
                low = np.frombuffer(row["low"], np.int64).reshape(-1, dim).astype(work)
                high = np.frombuffer(row["high"], np.int64).reshape(-1, dim).astype(work)
                least, most = interval(asked.x, low, high)
                least, most = least[asked.at], most[asked.at]
                needed = (most >= asked.low[:, None]) & (least <= asked.high[:, None])
                for j, kinds in enumerate(row["kinds"]):
                    needed[:, j] &= _others(kinds, asked.labels[asked.at], same)
                read = np.flatnonzero(needed.any(axis=0))
                if len(read):
                    best = np.where(needed[:, read], most[:, read], -np.inf if work is np.float64 else _NONE).max(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(read), row["tile"])), pa.array(np.full(len(read), row["shelf"])),
                            pa.array(np.array(row["blocks"], dtype=np.int64)[read]), pa.array(best.astype(np.int64)),
                        ],
                        names=["tile", "shelf", "block", "best"],
                    )

    group = F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")
    asks = tiles.withColumn("group", group).withColumnsRenamed({"low": "w_low", "high": "w_high"})
    every = shelves.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return every.join(asks, "group").drop("group").mapInArrow(run, "tile bigint, shelf bigint, block bigint, best bigint")


_FOUND = "anchor_id bigint, key bigint, mark bigint, vec_id bigint, score bigint"


def _met(blocks: DataFrame, shelves: DataFrame, tiles: DataFrame, groups: int, dim: int, stored: str, work: type, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of every window, ranked."""
    reads = written(blocks_to_read(shelves, tiles, groups, dim, stored, work, same), "reads")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("at", "array<int>"), ("key", "array<bigint>"), ("mark", "array<bigint>"))]
    have = reads.join(blocks.select("block", "ids", "labels", "q", "low", "high"), "block").select(
        "tile", "shelf", F.lit(1).alias("kind"), "best", "ids", "labels", "q", *nothing, "low", "high"
    )
    ask = reads.select("tile", "shelf").distinct().join(tiles, "tile").select(
        "tile", "shelf", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("best"), "ids", "labels", "q", "at", "key", "mark", "low", "high"
    )
    dealt = ask.union(have).repartition("tile", "shelf").sortWithinPartitions("tile", "shelf", "kind", F.desc("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if not row.column("kind")[0].as_py():
                    if asked is not None:
                        yield asked.rows()
                    asked = Asked(row.to_pylist()[0], dim, stored, work, k, same)
                    continue
                numbers = [row.column(c).flatten().to_numpy() for c in ("ids", "labels", "low", "high")]
                q = np.frombuffer(row.column("q")[0].as_py(), stored).reshape(-1, dim).astype(work)
                asked.meet(numbers[0], numbers[1], q, numbers[2], numbers[3])
        if asked is not None:
            yield asked.rows()

    best = dealt.mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floor_div(x: Column, by: int) -> Column:
    """Rounded down, exactly: division of whole numbers rounds towards zero."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` with one row per id; only ids are shuffled, and the rows of those that repeat."""
    again = written(rows.groupBy("id").count().where("count > 1").select("id"), "again")
    if again.isEmpty():
        return rows
    first = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r"))
    return rows.join(again, "id", "left_anti").unionByName(first.select("id", "r.label", "r.asks", "r.v"))


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90),
    scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """For each row that ``anchors`` marks and each of its ``positives`` best rows of its own label,
    the ``k`` best rows of other labels whose score is within ``window`` percent of the positive's.

    A score is the inner product of components floor(``scale`` * x); higher comes first, then the
    smaller id. Returned are ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where(F.col(id).isNotNull() & F.col(label).isNotNull() & finite(vector)).select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asks"), whole.alias("v"),
    )
    dim = only_length(rows, "v")
    if not dim:
        return spark.createDataFrame([], OUT)
    rows = _once(rows)
    n, mean, spread, most = _statistics(rows, dim)
    if most * most * dim >= 1 << 56:
        raise ValueError("inner products beyond 2^56")
    stored = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    work = np.float64 if most * most * dim < 1 << 53 else np.int64
    blocks = written(hilbert_blocks(rows, dim, n, mean, spread, stored, work, positives, rows_per_block), "blocks")
    tiles = written(_tiles(blocks, dim, stored), "tiles")
    groups = tiles.count()
    if not groups:
        return spark.createDataFrame([], OUT)
    shelves = written(_shelves(blocks), "shelves")
    how = (groups, dim, stored, work)
    best = written(_met(blocks, shelves, tiles, *how, positives, True), "positives")

    wanted = best.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("mark")).withColumns(
        {"low": -_floor_div(F.col("mark") * -window[0], 100), "high": _floor_div(F.col("mark") * window[1], 100)}
    )
    places = tiles.select("tile", F.posexplode("ids").alias("at", "anchor_id"))
    windows = places.join(wanted.where("low <= high"), "anchor_id").groupBy("tile").agg(
        F.array_sort(F.collect_list(F.struct("at", "key", "mark", "low", "high"))).alias("w")  # positives * ANCHORS_PER_TILE at most
    )
    asking = tiles.select("tile", "ids", "labels", "q").join(windows, "tile").select(
        "tile", "ids", "labels", "q", *[F.col(f"w.{c}").alias(c) for c in ("at", "key", "mark", "low", "high")]
    )
    found = _met(blocks, shelves, written(asking, "windows"), *how, k, False)
    return found.select(
        "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("mark").alias("positive_score"), F.col("score").alias("negative_score"),
    )

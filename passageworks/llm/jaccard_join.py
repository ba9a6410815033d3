"""Exact join of documents whose sets of word shingles are similar, by grouped prefixes.

A set is the distinct runs of ``size`` words (lower-cased in A-Z, cut at ASCII white space); a text
with fewer words is one run, a text without words is empty and linked with nothing. Documents a
and b are linked when 100 * |a and b| >= percent * |a or b|. Sets hold 64-bit hashes.

1.  One pass over the texts writes, per document, the size of its set, a 128-bit print of it, a
    parity map of 2,048 bits and its least hashes. Documents with equal prints are copies; only one
    of them goes on.
2.  A fixed order of all hashes makes similar sets share one of their first |a| - need + 1 hashes.
    The order is by hash, but hashes counted in more than HOT lists come last, so that passages
    shared by many documents meet nowhere. A document whose list runs short is read again whole.
3.  Documents of equal size and prefix are one group; groups are joined on the hashes of their
    prefixes, and pairs must agree in size and position and in their parity maps.
4.  Pairs that remain are verified on whole sets. First every group meets only the least group of
    each of its hashes; later pairs are only formed between components that are still apart,
    so a large group of near copies makes rows in proportion to its size, not to its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm import flat
from passageworks.llm.components import components
from passageworks.llm.store import written

BITS = 2048
HOT = 16  # a hash in more lists than this comes last in the order; it changes cost, not results
HEAVY = 64  # members of a hash from which pairs are tested on their parity maps where they meet
MOST_SENT = 1 << 20  # so many hot hashes (8 MB) are sent to the tasks, more are joined by shuffle

_SCHEMA = (
    "doc_id bigint, n_shingles bigint, p1 bigint, p2 bigint, least array<bigint>, bits array<bigint>"
)


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least common size at which sets of n and m hashes are similar enough."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / F.lit(100)) + 1


def _sets(rows: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct hashes of each text."""
    for _, part in flat.pieces(rows):
        data, offsets = flat.text_bytes(part)
        row, _, _, word = flat.words(data, offsets)
        row, value = flat.shingles(row, word, len(part), size)
        order = np.argsort(row, kind="stable")
        value = value[order].view(np.int64)
        ends = np.cumsum(np.bincount(row, minlength=len(part)))
        for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            yield np.unique(value[lo:hi])


def _parity(values: np.ndarray) -> np.ndarray:
    place = flat.mix(values.view(np.uint64)) % np.uint64(BITS)
    odd = (np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(docs: DataFrame, percent: int, size: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = batch.column(0), [], 0
            for values in _sets(batch.column(1), size):
                n = len(values)
                first = n - -(-percent * n // 100) + 1
                mixed = flat.mix(values.view(np.uint64))
                out.append((
                    n, int(mixed.sum().view(np.int64)), int(flat.mix(mixed).sum().view(np.int64)),
                    values[: first + first // 4 + 8] if n else values, _parity(values),
                ))
                held += 1
                if len(out) == 2000:
                    yield _signed(ids.slice(held - len(out), len(out)), out)
                    out = []
            if out:
                yield _signed(ids.slice(held - len(out), len(out)), out)

    return docs.select("doc_id", text).mapInArrow(run, _SCHEMA)


def _signed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, p1, p2, least, bits = zip(*rows, strict=True)
    arrays = [ids, *(pa.array(x, pa.int64()) for x in (n, p1, p2)), _lists(least), _lists(bits)]
    return pa.RecordBatch.from_arrays(
        arrays, names=["doc_id", "n_shingles", "p1", "p2", "least", "bits"]
    )


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str) -> DataFrame:
    """``rep, hashes`` for the documents whose id is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, done = [], 0
            for values in _sets(batch.column(1), size):
                out.append(values)
                done += 1
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done - len(out), len(out)), _lists(out)], names=["rep", "hashes"]
                    )
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done - len(out), len(out)), _lists(out)], names=["rep", "hashes"]
                )

    found = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return found.select("doc_id", text).mapInArrow(run, "rep bigint, hashes array<bigint>")


def _prefixes(
    docs: DataFrame, signed: DataFrame, copied: DataFrame, percent: int, size: int, text: str
) -> tuple[DataFrame, DataFrame]:
    """``rep, n, prefix``: the first hashes of each set in the order (hot, hash), without copies;
    and the hashes that may lie in several of them.

    The lists are shuffled once, to meet what is known of their document: the prints by which it
    is a copy, and its hot hashes.
    """
    each = signed.select("doc_id", F.explode("least").alias("h"))
    common = written(each.groupBy("h").count().where("count > 1"), "common")
    hot = common.where(F.col("count") > HOT).select("h")
    few = hot.count() <= MOST_SENT
    has = each.join(F.broadcast(hot) if few else hot, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hot"))
    notes = has.join(copied, "doc_id", "full")
    need = prefix_size(F.col("n"), percent).cast("int")
    cold = F.when(F.col("hot").isNull(), F.col("least")).otherwise(F.array_except("least", "hot"))
    # A list that holds the whole set needs no second reading.
    whole = F.size("least") >= F.col("n")
    last = F.when(whole & F.col("hot").isNotNull(), F.array_sort("hot")).otherwise(F.array())
    first = written(
        signed.select("doc_id", F.col("n_shingles").alias("n"), "p1", "least")
        .join(notes, "doc_id", "left")
        .where(F.col("copies").isNull() | ~F.array_contains("copies", F.col("p1")))
        .withColumn("cold", cold)
        .select(
            F.col("doc_id").alias("rep"), "n",
            F.when((F.size("cold") >= need) | whole, F.slice(F.concat("cold", last), F.lit(1), need)).alias("prefix"),
        ),
        "prefixes",
    )
    again = written(whole_sets(docs, first.where("prefix IS NULL").select("rep"), size, text), "again")
    all_hot = again.select("rep", F.explode("hashes").alias("h")).join(F.broadcast(hot) if few else hot, "h")
    full = F.when(F.col("hot").isNull(), F.col("hashes")).otherwise(
        F.concat(F.array_except("hashes", "hot"), F.array_sort("hot"))
    )
    second = again.join(all_hot.groupBy("rep").agg(F.collect_set("h").alias("hot")), "rep", "left").select(
        "rep", F.size("hashes").cast("long").alias("n"), full.alias("all")
    )
    second = written(second.select("rep", "n", F.slice("all", F.lit(1), need).alias("prefix")), "second")
    shared = common.select("h").union(second.select(F.explode("prefix").alias("h"))).distinct()
    return first.where("prefix IS NOT NULL").union(second), shared


def _folded(bits: Column) -> Column:
    """A parity map of a quarter of the bits: parities of the union of four places."""
    words = BITS // 256
    fold = lambda i: bits[i].bitwiseXOR(bits[i + words]).bitwiseXOR(bits[i + 2 * words]).bitwiseXOR(bits[i + 3 * words])
    return F.array(*(fold(i) for i in range(words)))


def _differ(a: str, b: str, words: int = BITS // 64) -> Column:
    """In how many bits two parity maps differ; written out, so that it is compiled."""
    count = F.lit(0)
    for i in range(words):
        count = count + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return count


def _far(percent: int) -> Column:
    """Whether the parity maps differ in more bits than similar sets may."""
    return _differ("a_bits", "b_bits") > F.col("a_n") + F.col("b_n") - 2 * _need(F.col("a_n"), F.col("b_n"), percent)


def _side(table: DataFrame, side: str, key: str) -> DataFrame:
    return table.select(*(F.col(c).alias(side if c == key else f"{side}_{c}") for c in table.columns))


def _verified(
    docs: DataFrame, pairs: DataFrame, signed: DataFrame, percent: int, size: int, text: str, name: str
) -> DataFrame:
    """Of the pairs ``a < b`` those that are similar enough, by their whole sets."""
    maps = signed.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits")
    pairs = written(pairs.distinct(), f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    maps = maps.join(ends, "rep", "left_semi")
    near = pairs.join(_side(maps, "a", "rep"), "a").join(_side(maps, "b", "rep"), "b")
    near = written(near.where(~_far(percent)).select("a", "b").distinct(), name)
    wanted = near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep")))
    sets = written(whole_sets(docs, wanted, size, text), f"{name}-sets")
    near = near.join(_side(sets, "a", "rep"), "a").join(_side(sets, "b", "rep"), "b")
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    union = F.size("a_hashes") + F.size("b_hashes") - both
    return near.where(100 * both >= percent * union).select("a", "b").distinct().checkpoint()


def similar_documents(
    docs: DataFrame, percent: int = 80, size: int = 5, text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (columns doc_id and ``text``).

    component_id is the least doc_id that links reach, the document itself included. Null texts
    are empty. Rows without doc_id are returned without a component and linked with nothing. Rows
    that repeat a doc_id are one document, linked by each of its texts, and each is returned. An
    empty table gives none; further columns are ignored.
    """
    docs = docs.select("doc_id", text)
    signed = written(signatures(docs, percent, size, text), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    prints = ["p1", "p2", "n_shingles"]
    copies = known.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"))
    member = (
        known.select("doc_id", *prints).join(copies.where("k > 1"), prints)
        .where("doc_id <> rep").select("doc_id", "rep", "p1").checkpoint()
    )
    copied = member.groupBy("doc_id").agg(F.collect_set("p1").alias("copies"))
    links = _links(docs, known, copied, percent, size, text)
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        member.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    )
    found = components(edges).withColumnRenamed("node", "doc_id")
    return (
        signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def _links(
    docs: DataFrame, signed: DataFrame, copied: DataFrame, percent: int, size: int, text: str
) -> DataFrame:
    """Links ``a, b`` that connect all documents which links connect, copies left out."""
    prefixes, shared = _prefixes(docs, signed, copied, percent, size, text)
    marked = prefixes.select("rep", "n", F.xxhash64("prefix").alias("x"), F.hash("prefix").alias("y"))
    alike = marked.groupBy("n", "x", "y").agg(F.min("rep").alias("group"), F.count(F.lit(1)).alias("k"))
    inside = (
        marked.join(alike.where("k > 1"), ["n", "x", "y"])
        .where("rep <> group").select("rep", "n", "group").checkpoint()
    )
    of_groups = prefixes.join(inside.select("rep", "n"), ["rep", "n"], "left_anti")
    each = of_groups.select(F.col("rep").alias("group"), "n", F.posexplode("prefix").alias("pos", "h"))
    index = written(each.join(shared, "h"), "index")

    def usable(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        need = _need(n, m, percent)
        return (
            (100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (F.col(f"{x}.pos") <= n - need) & (F.col(f"{y}.pos") <= m - need)
        )

    # Members of a group meet its least member; groups meet the least group of each hash.
    centre = index.groupBy("h").agg(F.min(F.struct("group", "n", "pos")).alias("c"), F.count(F.lit(1)).alias("k"))
    centre = centre.where("k > 1").select("h", "c.group", "c.n", "c.pos")
    first = (
        index.alias("x").join(centre.alias("y"), "h")
        .where((F.col("x.group") > F.col("y.group")) & usable("x", "y"))
        .select(F.col("y.group").alias("a"), F.col("x.group").alias("b"))
        .union(inside.select(F.col("group").alias("a"), F.col("rep").alias("b")))
    )
    links = _verified(docs, first, signed, percent, size, text, "first")
    # Afterwards groups are expanded, and only members of different components meet.
    members = index.select("h", "n", "pos", F.col("group").alias("rep")).union(
        index.join(inside, ["group", "n"]).select("h", "n", "pos", "rep")
    )
    # Two documents linked to one centre are connected, which is all that is used here: whoever
    # keeps apart from its component only costs a comparison more.
    known = links.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("component"))
    labelled = written(
        members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members"
    )
    mixed = (
        labelled.groupBy("h")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"))
        .where("lo < hi").select("h", "k").checkpoint()
    )

    def meet(apart: DataFrame, near: Column | bool) -> DataFrame:
        return (
            apart.alias("x").join(apart.alias("y"), "h")
            .where(
                (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
                & usable("x", "y") & near
            )
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        )

    rare = labelled.join(mixed.where(F.col("k") <= HEAVY).select("h"), "h")
    heavy = labelled.join(mixed.where(F.col("k") > HEAVY).select("h"), "h")
    folded = _folded(F.col("bits")).alias("bits")
    maps = signed.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), folded)
    # Where many meet, a pair becomes a row only if its parity maps allow a link; short maps, as
    # they travel with every row.
    heavy = heavy.join(maps, ["rep", "n"])
    least = F.col("x.n") + F.col("y.n") - 2 * _need(F.col("x.n"), F.col("y.n"), percent)
    rest = meet(rare, F.lit(True)).union(meet(heavy, _differ("x.bits", "y.bits", BITS // 256) <= least))
    return links.union(_verified(docs, rest, signed, percent, size, text, "rest"))

"""Mixing sources to target weights by a splitting tree of block quotas; DataFrame functions only.

1.  Every document gets a hash; the documents of a source fall by it into blocks of about BLOCK.
    As the hash is random, block numbers are in permuted order. The hash is all that decides, so
    reruns agree, in whatever order the rows come.
2.  Weights give each source a target number of words, at most MOST times its size. A target is
    met by whole passes over the source's blocks, then by its first blocks, and within the last of
    these by the documents of least hash. Each block of each pass is one unit. Copies of a row share
    a hash; where a target ends among them, they are numbered and only so many of them are taken.
3.  The exact numbers of units per source are split over the output shards by a tree: each node
    hands its left half of shards a multivariate hypergeometric share, drawn source after source
    by inverting the distribution, with a hash of the node as the random number.
4.  Each source's units, permuted once more, are dealt out by the quotas of the leaves, disjointly;
    rows are then shuffled only within their shard.

Rows that are grouped or ordered together are those of one block, or sums of blocks; the source of
a third of all rows has more blocks, not larger ones. Null texts have no words, null sources are a
source of their own (the last); rows that repeat are taken one by one, so that a target is met
to within a row even if all rows are copies of one; an empty table gives an empty mix; sources
without words take nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.store import written
from passageworks.operators.ordinal import number_rows

BLOCK = 256  # documents of a block
SHARD = 64  # blocks of a shard
MOST = 3  # times that a document may be taken
WEIGHTS = (5, 2, 1)  # of the sources in the order of their names, repeating
_SUMMED = 512  # blocks whose words are summed before the running sum over a source
_SENT = 100_000  # sources (and blocks) up to which their table is sent to the tasks


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _key(seed: int, text: str) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col(text), F.lit(seed))


def _sent(small: DataFrame) -> DataFrame:
    """Marked for broadcast if it is as small as expected; otherwise joined by shuffle."""
    return F.broadcast(small) if small.count() <= _SENT else small


def source_targets(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``i, source, source_size, target, n_docs`` from ``source, source_size, n_docs``.

    Targets share all words by weight. A source whose target would be above MOST times its size
    gets that much, and the rest is shared again by weight, until none is above. A round is one sum
    over the sources; only their common level, words for a unit of weight, reaches the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = number_rows(dealt, [], order, F.col("_range"), "i").withColumn("i", (F.col("i") - 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": MOST * F.col("source_size")}).checkpoint()
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (whole[0] or 0) / (whole[1] or 1), -1.0
    while level != before:
        full = F.col("most") <= F.col("weight") * level
        kept, open_ = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (whole[0] - (kept or 0)) / open_ if open_ else level
    full = F.col("most") <= F.col("weight") * level
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return ranked.withColumn("target", target).select("i", "source", "source_size", "target", "n_docs")


def _log_factorial(n: Column) -> Column:
    """Exact to 20, then Stirling's series (an error below 1e-13)."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * 3.141592653589793 * x)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` of ``total`` units are ``marked``, for the uniform number ``u``.

    The distribution is inverted over ten standard deviations about its mean; what lies beyond has
    a probability below 1e-20.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1)))) * 10 + 3
    lo = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - spread)).cast("long")
    hi = F.least(drawn, marked, F.ceil(mean + spread)).cast("long")

    def log_weight(x: Column) -> Column:
        return -(
            _log_factorial(x) + _log_factorial(marked - x)
            + _log_factorial(drawn - x) + _log_factorial(total - marked - drawn + x)
        )

    def invert(lo: Column, weights: Column) -> Column:
        """The first place at which the running sum of the weights reaches u times their sum."""
        state = lambda left, i: F.struct(left.alias("left"), i.alias("i"))
        step = lambda s, p: state(s["left"] - p, s["i"] + F.when(s["left"] > p, 1).otherwise(0))
        whole = F.aggregate(weights, F.lit(0.0), lambda s, p: s + p)
        last = F.size(weights) - 1
        return lo + F.least(F.aggregate(weights, state(u * whole, F.lit(0)), step)["i"], last)

    def scaled(logs: Column) -> Column:
        return _let(F.array_max(logs), lambda top: F.transform(logs, lambda l: F.exp(l - top)))

    drawn_from = _let(lo, lambda lo: _let(
        F.transform(F.sequence(lo, F.greatest(lo, hi)), log_weight),
        lambda logs: _let(scaled(logs), lambda weights: invert(lo, weights)),
    ))
    return F.when(hi <= lo, lo).otherwise(drawn_from)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, quotas`` of every shard, from the one row ``quotas`` (an array of long).

    All of the units are handed out; a shard's number of units differs from another's by rounding
    only. Nodes of a level are rows, spread over the tasks as they become many.
    """
    level = quotas.select(F.lit(0).alias("shard"), F.lit(shards).alias("n"), "quotas")
    for depth in range(max(0, shards - 1).bit_length()):
        half = F.floor(F.col("n") / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, k: s + k)
        drawn = F.floor(total * half / F.col("n")).cast("long")
        state = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("out"))

        def draw(s: Column, k: Column) -> Column:
            u = _uniform(F.col("shard"), F.col("n"), F.size(s["out"]), F.lit(seed))
            x = _hypergeometric(s["total"], k, s["drawn"], u)
            return F.transform(
                F.array(x),
                lambda x: F.struct(
                    (s["total"] - k).alias("total"), (s["drawn"] - x).alias("drawn"),
                    F.concat(s["out"], F.array(x)).alias("out"),
                ),
            )[0]

        left = F.aggregate("quotas", state, draw)["out"]
        children = F.transform(
            F.array(left),
            lambda l: F.array(
                F.struct(F.col("shard").alias("shard"), half.alias("n"), l.alias("quotas")),
                F.struct(
                    (F.col("shard") + half).alias("shard"), (F.col("n") - half).alias("n"),
                    F.zip_with("quotas", l, lambda a, b: a - b).alias("quotas"),
                ),
            ),
        )[0]
        same = F.array(F.struct("shard", "n", "quotas"))
        level = level.select(F.explode(F.when(F.col("n") > 1, children).otherwise(same)).alias("c")).select("c.*")
        if depth % 8 == 7:
            level = level.repartition("shard").checkpoint()
    return level.select("shard", "quotas")


@dataclass
class Mix:
    """The plan of a mix: targets of the sources, and the shards to which each block goes.

    ``blocks`` holds ``i, block, units`` (pass, shard, the greatest hash taken of the block, and how
    many copies of it; null for all). ``sources`` holds ``i, source, source_size, target, n_blocks``,
    ``cuts`` the ``i, key`` of the copies among which a target ends, one for a source at most.
    """

    sources: DataFrame
    blocks: DataFrame
    cuts: DataFrame
    seed: int
    text: str

    def placed(self, docs: DataFrame) -> DataFrame:
        """``row`` (all columns of ``docs``), ``key, size, source_size, target`` and ``units``.

        ``units`` has an element for each time that the row is taken.
        """
        keyed = docs.select(
            F.struct(*docs.columns).alias("row"), F.col("source").alias("name"),
            _key(self.seed, self.text).alias("key"), words(F.col(self.text)).alias("size"),
        )
        per = _sent(self.sources.select("i", "source", "source_size", "target", "n_blocks"))
        joined = keyed.join(per, F.col("name").eqNullSafe(F.col("source"))).select(
            "row", "key", "size", "i", "source_size", "target", _block(F.col("key"), F.col("n_blocks")).alias("block")
        )
        joined = self._numbered(joined).join(_sent(self.blocks), ["i", "block"], "left")
        taken = F.filter("units", self._takes)
        none = F.array().cast(self.blocks.schema["units"].dataType)
        return joined.withColumn("units", F.coalesce(taken, none)).drop("copy")

    @staticmethod
    def _takes(unit: Column) -> Column:
        within = unit["copies"].isNull() | (F.col("copy") <= unit["copies"])
        return unit["most"].isNull() | (F.col("key") < unit["most"]) | ((F.col("key") == unit["most"]) & within)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number ``copy`` of those among which a target ends; 1 for the others.

        Copies are equal, so any numbers give the same mix. They are counted in blocks, so a third
        of all rows may be copies of one.
        """
        if self.cuts.isEmpty():
            return rows.withColumn("copy", F.lit(1).cast("long"))
        cuts = _sent(self.cuts)
        among = written(rows.join(cuts, ["i", "key"], "left_semi").withColumn("_at", F.monotonically_increasing_id()), "copies")
        numbered = number_rows(among, ["i", "key"], ["_at"], F.shiftright("_at", 10), "copy").drop("_at")
        others = rows.join(cuts, ["i", "key"], "left_anti").withColumn("copy", F.lit(1).cast("long"))
        return others.unionByName(numbered.withColumn("copy", F.col("copy").cast("long")))


def _block(key: Column, blocks: Column) -> Column:
    # The low bits order documents within a block, the high ones choose it.
    return F.pmod(F.shiftrightunsigned(key, 20), blocks)


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 17, text: str = "text"
) -> Mix:
    """The plan for ``docs`` (columns doc_id, source and ``text``); one pass over the texts."""
    narrow = written(
        docs.select("source", _key(seed, text).alias("key"), words(F.col(text)).alias("size")), "sizes"
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    sources = (
        source_targets(sizes, weights)
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long"))
        .withColumn("passes", passes.cast("long"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .checkpoint()
    )
    per = _sent(sources.select("i", "source", "n_blocks")).alias("s")
    found = narrow.alias("d").join(per, F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "i", "key", "size", _block(F.col("key"), F.col("n_blocks")).alias("block")
    )
    sums = found.groupBy("i", "block").agg(F.sum("size").alias("words"))
    every = sources.select("i", "n_blocks", "passes", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    every = every.join(sums, ["i", "block"], "left").fillna(0, ["words"]).withColumn("part", F.floor(F.col("block") / _SUMMED))
    # A running sum in two steps: over parts of a source, and over the blocks of a part.
    parts = every.groupBy("i", "part").agg(F.sum("words").alias("sum"))
    before = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("i", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("i", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(
        every.withColumn("start", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(parts, ["i", "part"])
        .withColumn("start", F.col("start") + F.col("offset"))
        .withColumn("extra", F.col("start") < F.col("rest"))
        .withColumn("left", F.col("rest") - F.col("start"))
        .select("i", "block", "n_blocks", "passes", "words", "extra", "left"),
        "blocks",
    )
    # The block in which a target ends is taken up to the row whose middle is nearest: first by
    # hash, then copy by copy.
    last = blocks.where(F.col("extra") & (F.col("left") < F.col("words"))).select("i", "block", "left")
    kinds = found.join(_sent(last), ["i", "block"]).groupBy("i", "block", "left", "key").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    ordered = Window.partitionBy("i", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("left") - F.col("sum") + F.col("size") * F.col("n") + F.col("size") / 2
    copies = F.least("n", F.floor(room / F.greatest("size", F.lit(1))))
    ends = (
        kinds.withColumn("sum", F.sum(F.col("size") * F.col("n")).over(ordered))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
        .where("copies > 0")
        .groupBy("i", "block").agg(F.max(F.struct("key", "copies", "n")).alias("e"))
    )
    ends = last.select("i", "block").join(ends, ["i", "block"], "left").select(
        "i", "block", F.coalesce("e.key", F.lit(-(1 << 63)).cast("long")).alias("most"),
        F.when(F.col("e.copies") < F.col("e.n"), F.col("e.copies")).alias("copies"),
    ).checkpoint()
    counts = blocks.groupBy("i").agg(
        (F.max("passes") * F.max("n_blocks") + F.sum(F.col("extra").cast("long"))).alias("k")
    )
    counts = counts.checkpoint()
    total = counts.agg(F.sum("k")).first()[0] or 0
    n_shards = max(1, -(-total // SHARD))
    row = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda e: e["k"]).alias("quotas"))

    leaves = split_quotas(row, int(n_shards), seed)
    # Sources are numbered from 0 without gaps, so a place in the array is the number.
    leaves = leaves.select("shard", F.posexplode("quotas").alias("i", "x")).where("x > 0")
    dealt = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("start", F.coalesce(F.sum("x").over(dealt), F.lit(0).cast("long")))
    dealt_units = leaves.select("i", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("x") - 1)).alias("place"))
    times = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("extra"), F.lit(0)).otherwise(F.lit(1)))
    units = (
        blocks.where(F.col("extra") | (F.col("passes") > 0))
        .select("i", "block", "n_blocks", "passes", F.explode(times).alias("pass"))
        .join(_sent(counts), "i")
        .withColumn("place", F.pmod((F.col("pass") * F.col("n_blocks") + F.col("block")) * F.lit(2654435761) + F.lit(seed), F.col("k")))
        .join(dealt_units, ["i", "place"])
        .join(ends, ["i", "block"], "left")
        .select("i", "block", F.struct("pass", "shard", *[F.when(F.col("pass") == F.col("passes"), F.col(c)).alias(c) for c in ("most", "copies")]).alias("unit"))
    )
    units = written(units.groupBy("i", "block").agg(F.collect_list("unit").alias("units")), "units")
    cuts = ends.where("copies IS NOT NULL").select("i", F.col("most").alias("key"))
    return Mix(sources, units, cuts, seed, text)


def mixed(docs: DataFrame, plan: Mix, partitions: int | None = None) -> DataFrame:
    """The mix: every taken row with all columns of ``docs``, and a last column ``shard``
    (``_shard`` and so on beside a column of that name).

    Shards are the partitions' ranges; within one, rows are in the order of a hash of row and pass.
    """
    taken = plan.placed(docs).select("row", "key", F.explode("units").alias("unit"))
    dealt = taken.repartition(partitions, "unit.shard") if partitions else taken.repartition("unit.shard")
    order = F.xxhash64("key", F.col("unit.pass"), F.lit(plan.seed))
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    return dealt.sortWithinPartitions("unit.shard", order).select("row.*", F.col("unit.shard").alias(name))


def taken_words(docs: DataFrame, plan: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``, and the ``shards``
    (numbers joined by commas) to which it goes."""
    return plan.placed(docs).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.size("units") * F.col("size")).cast("long").alias("taken"),
        F.array_join(F.array_sort(F.transform("units", lambda u: u["shard"])), ",").alias("shards"),
    )

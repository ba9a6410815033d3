"""Personal data: generators propose overlapping spans, boosted trees choose among them.

1.  One pass over the texts keeps the regions that can hold personal data: runs of digits with
    the marks of numbers, runs around an at sign, and spelled-out addresses.
2.  Within a region, generators of high recall propose overlapping spans. The fixed patterns of the
    base kinds are among them; a base match that meets its check is a base span, and stays.
3.  A proposal inside a base span is a positive example, any other a negative one. Examples of equal
    format and context features are counted over all rows, so training reads distinct feature
    vectors with weights, never a sample. Gradient-boosted trees learn from four folds of values.
4.  The fifth fold calibrates: of each kind, the threshold is the least score from which on
    PRECISION of the held-out examples are positive. Proposals from the threshold on that touch no
    base span become spans of kind ``likely_...``, unless they lie inside another one.

Format features never say whether a proposal was verified as a whole, and context is read outside
its region. So a card number that stands next to a phone number, which the base pattern takes as one
run of too many digits, is proposed and scored by itself, as is a phone number without its prefix.

All of it is DataFrame functions and the trees of Spark's own library: no Python worker runs.
Offsets are code points, ends exclusive. Null texts are empty; without examples of both kinds
nothing is added. Repeated rows, and rows that share or lack an id, are each scanned as rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.matches import places
from passageworks.llm.store import written

KINDS = ("email", "ip", "card", "phone")
LIKELY = tuple(f"likely_{k}" for k in KINDS)

_LOCAL = r"[A-Za-z0-9._%+-]"
# Regions of a text. Each holds every base match that begins in it, whole. The bounded head and the
# possessive runs keep the time linear in the text.
NUMBERS = r"[+(]{0,2}[0-9][+0-9 ().-]*+"
AT_SIGNS = rf"(?<!{_LOCAL}){_LOCAL}*+@[A-Za-z0-9._%+@-]*+"
SPELLED = (
    rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[({{] ?(?i:at) ?[\])}}] ?[A-Za-z0-9-]++"
    r"(?: ?[\[({] ?(?i:dot) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
)

# Base patterns, as the fixed ones of the kinds but with runs that never give back what they took.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Further proposals: region, kind and pattern.
PROPOSED = [
    (SPELLED, "email", SPELLED),
    (NUMBERS, "ip", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    (NUMBERS, "card", r"[0-9]{7,}+"),
    (NUMBERS, "card", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?+(?![0-9])"),
    (NUMBERS, "phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2}(?![0-9])"),
    (NUMBERS, "phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){3}(?![0-9])"),
    (NUMBERS, "phone", r"(?:(?<![0-9])|(?=\())\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
]

CUES = [
    r"(?i)\b(?:phone|tel|mobile|fax|call)",
    r"(?i)\b(?:card|visa|credit|account|payment)",
    r"(?i)\b(?:ip|host|server|address)",
    r"(?i)\b(?:mail|contact|write)",
]

FEATURES = [
    "f_kind", "f_digits", "f_groups", "f_first", "f_last", "f_plus", "f_paren", "f_dash", "f_dot", "f_space",
    "f_luhn", "f_parts", "f_before", "f_after", "f_cue", "f_labels", "f_top",
]
LEAST_DIGITS = 7  # of a proposed card or phone number
PRECISION = 0.95  # of held-out examples from the threshold on
LEAST_HELD_OUT = 20  # positive held-out examples of a kind, below which nothing of it is added
FOLDS = 5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's sum; false for any other number of digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return F.when(F.char_length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _regions(docs: DataFrame, text: str) -> DataFrame:
    """``rid, doc_id, regions`` of every row; the texts themselves are not kept."""

    def of_sort(number: int, pattern: str) -> Column:
        return F.transform(
            places(F.col(text), pattern),
            lambda p: F.struct(F.lit(number).alias("sort"), p["start"], p["value"], p["left"], p["right"]),
        )

    arrays = [of_sort(*s) for s in enumerate((NUMBERS, AT_SIGNS, SPELLED))]
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*arrays).alias("regions")
    )


def _proposals(rows: DataFrame) -> DataFrame:
    """One row per proposal: place, kind, whether it is a base span, fold and features."""
    region = rows.select("rid", F.explode("regions").alias("r")).select("rid", "r.*")

    def within(sort: int, kind: str, pattern: str, base: bool) -> Column:
        number = KINDS.index(kind)
        found = F.transform(
            places(F.col("value"), pattern, 1),
            lambda p: F.struct(
                F.lit(number).alias("kind"), F.lit(base).alias("fixed"), p["start"].alias("at"), p["end"].alias("to"),
                p["value"].alias("span"), p["left"].alias("before"), p["right"].alias("after"),
            ),
        )
        nothing = F.expr(
            "cast(array() as array<struct<kind: int, fixed: boolean, at: int, to: int, span: string, "
            "before: string, after: string>>)"
        )
        return F.when(F.col("sort") == sort, found).otherwise(nothing)

    sorts = {NUMBERS: 0, AT_SIGNS: 1, SPELLED: 2}
    each = [within(1, "email", BASE["email"], True)]
    each += [within(0, kind, BASE[kind], True) for kind in KINDS[1:]]
    each += [within(sorts[where], kind, pattern, False) for where, kind, pattern in PROPOSED]
    fold = F.pmod(F.xxhash64("value"), F.lit(FOLDS)).cast("int").alias("fold")
    span = region.select("rid", "start", fold, "left", "right", F.explode(F.concat(*each)).alias("p"))
    beside = lambda near, far: F.when(F.col(near) == "", F.col(far)).otherwise(F.col(near))
    span = span.select(
        "rid", "fold", "left", "p.kind", "p.fixed", "p.span",
        beside("p.before", "left").alias("before"), beside("p.after", "right").alias("after"),
        (F.col("start") + F.col("p.at")).cast("long").alias("start"),
        (F.col("start") + F.col("p.to")).cast("long").alias("end"),
    )
    return _described(span)


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _described(span: DataFrame) -> DataFrame:
    s, kind = F.col("span"), F.col("kind")
    span = span.withColumn("digits", digits_of(s))
    span = span.withColumn("groups", F.filter(F.split(s, "[^0-9]+"), lambda g: g != ""))
    n, groups = F.char_length("digits"), F.col("groups")
    few = lambda x, most: F.least(F.coalesce(x, F.lit(0)), F.lit(most)).cast("int")
    letter = "[A-Za-z0-9_]"
    cue = F.lit(0)
    for number, words in enumerate(CUES, 1):
        cue = F.when(F.col("left").rlike(words), number).otherwise(cue)
    email = kind == 0
    labels = F.split(s, r"[@.]|(?i: ?[\[({] ?(?:at|dot) ?[\])}] ?)")
    features = {
        "f_kind": kind,
        "f_digits": F.when(email, 0).otherwise(few(n, 24)),
        "f_groups": F.when(email, 0).otherwise(few(F.size(groups), 8)),
        "f_first": F.when(email, 0).otherwise(few(F.char_length(F.get(groups, F.lit(0))), 8)),
        "f_last": F.when(email, 0).otherwise(few(F.char_length(F.try_element_at(groups, F.lit(-1))), 8)),
        "f_plus": _flag(~email & s.contains("+")),
        "f_paren": _flag(~email & s.contains("(")),
        "f_dash": _flag(~email & s.contains("-")),
        "f_dot": _flag(~email & s.contains(".")),
        "f_space": _flag(~email & s.contains(" ")),
        "f_luhn": _flag(luhn(F.col("digits"))),
        "f_parts": _flag(s.rlike(IP_PARTS)),
        "f_before": _flag(F.col("before").rlike(f"{letter}$")),
        "f_after": _flag(F.col("after").rlike(f"^{letter}")),
        "f_cue": cue,
        "f_labels": F.when(email, few(F.size(labels), 6)).otherwise(0),
        "f_top": F.when(email, few(F.char_length(F.element_at(labels, -1)), 8)).otherwise(0),
    }
    right = (
        F.when(kind == 0, True)
        .when(kind == 1, s.rlike(IP_PARTS))
        .when(kind == 2, luhn(F.col("digits")))
        .otherwise(n.between(9, 15))
    )
    made = span.withColumns({f: c.cast("int") for f, c in features.items()})
    return made.withColumn("base", F.col("fixed") & right).where(
        F.col("base") | (kind < 2) | (n >= LEAST_DIGITS)
    ).select("rid", "kind", "start", "end", "base", "fold", *FEATURES)


def _beside_base(spans: DataFrame) -> DataFrame:
    """Adds ``inside`` a base span, and whether a span ``touches`` one, by running maxima."""
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = (
        Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("base"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # A base span that begins within this one comes later in that order, so it is met from behind.
    behind = (
        Window.partitionBy("rid").orderBy(F.desc("start"), "end", "base")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach, next_base = F.max(base_end).over(before), F.min(base_start).over(behind)
    return spans.withColumns(
        {
            "inside": F.coalesce(reach >= F.col("end"), F.lit(False)),
            "touches": F.coalesce(reach > F.col("start"), F.lit(False))
            | F.coalesce(next_base < F.col("end"), F.lit(False)),
        }
    )


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


@dataclass(frozen=True)
class Chooser:
    """Boosted trees with a threshold for each kind (by its number) that reached the precision."""

    trees: GBTClassificationModel
    least: dict[int, float]

    def scored(self, spans: DataFrame) -> DataFrame:
        out = self.trees.transform(_assembled(spans))
        return out.withColumn("score", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction"
        )

    def chosen(self, spans: DataFrame) -> DataFrame:
        passed = F.lit(False)
        for kind, least in sorted(self.least.items()):
            passed = passed | ((F.col("kind") == kind) & (F.col("score") >= least))
        return self.scored(spans).where(passed)


def learn(spans: DataFrame, rounds: int = 12, depth: int = 4, precision: float = PRECISION) -> Chooser | None:
    """Trees and thresholds from all ``spans``; none if only one kind of example exists."""
    counted = spans.groupBy(*FEATURES, "fold", F.col("inside").cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    counted = written(counted, "examples")
    there = {r["y"] for r in counted.where("fold <> 0").select("y").distinct().collect()}
    if there != {0.0, 1.0}:
        return None
    trees = GBTClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth,
        stepSize=0.3, seed=1,
    ).fit(_assembled(counted.where("fold <> 0")))
    held_out = Chooser(trees, {}).scored(counted.where("fold = 0"))
    held_out = held_out.groupBy("f_kind", F.floor(F.col("score") * 100).alias("bin"))
    bins = held_out.agg(F.sum(F.col("weight") * F.col("y")).alias("hits"), F.sum("weight").alias("all"))
    return Chooser(trees, thresholds([tuple(r) for r in bins.collect()], precision))


def thresholds(bins: list[tuple[int, int, float, float]], precision: float) -> dict[int, float]:
    """From (kind, hundredth of score, positives, examples): each kind's least score at which the
    examples from there on are positive often enough; none below LEAST_HELD_OUT positives."""
    least = {}
    for kind in {b[0] for b in bins}:
        hits = seen = 0.0
        for _, at, good, n in sorted((b for b in bins if b[0] == kind), key=lambda b: -b[1]):
            hits, seen = hits + good, seen + n
            if hits >= precision * seen and hits >= LEAST_HELD_OUT:
                least[kind] = at / 100
    return least


def _outermost(spans: DataFrame) -> DataFrame:
    """Without spans that lie inside another one of their row, or repeat it."""
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).where("_reach IS NULL OR _reach < end").drop("_reach")


def _found(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (``rid, doc_id``) and all their spans (``rid, kind, start, end``); kinds from
    len(KINDS) on are likely ones."""
    rows = written(_regions(docs, text), "regions")
    spans = written(_beside_base(_proposals(rows)), "proposals")
    base = spans.where("base").select("rid", "kind", "start", "end")
    chooser = learn(spans)
    if chooser is not None and chooser.least:
        added = _outermost(chooser.chosen(spans.where("NOT touches")))
        base = base.union(added.select("rid", (F.col("kind") + len(KINDS)).alias("kind"), "start", "end"))
    return rows.select("rid", "doc_id"), base


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *LIKELY)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row ``doc_id``, the number of base spans of each kind, the hash of the base spans as
    text, and all ``spans`` as text (``kind:start:end`` by kind, then start, joined by commas);
    ``n_likely`` counts the added ones."""
    rows, spans = _found(docs, text)
    by_row = spans.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("all")
    )
    joined = rows.join(by_row, "rid", "left").select("doc_id", F.coalesce("all", F.array()).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))

    def count(number: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts, F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("all")).alias("spans"),
        (F.size("all") - F.size(base)).cast("long").alias("n_likely"),
    )

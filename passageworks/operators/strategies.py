"""Names, labels and parameters of the six chunking strategies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks import schema

BY_SENTENCE = "BY_SENTENCE"
BY_SENTENCE_WITH_SLIDING_WINDOW = "BY_SENTENCE_WITH_SLIDING_WINDOW"
BY_PARAGRAPH = "BY_PARAGRAPH"
EVERY_N_WORDS = "EVERY_N_WORDS"
RECURSIVE_CHARACTER_TEXT_SPLITTING = "RECURSIVE_CHARACTER_TEXT_SPLITTING"
SEMANTIC_CHUNKING = "SEMANTIC_CHUNKING"

STRATEGIES = (
    BY_SENTENCE,
    BY_SENTENCE_WITH_SLIDING_WINDOW,
    BY_PARAGRAPH,
    EVERY_N_WORDS,
    RECURSIVE_CHARACTER_TEXT_SPLITTING,
    SEMANTIC_CHUNKING,
)


@dataclass(frozen=True)
class ChunkSizes:
    characters: int = schema.CHUNK_SIZE
    overlap: int = schema.CHUNK_OVERLAP
    words: int = schema.WORDS_PER_CHUNK
    sentences: int = schema.SENTENCES_PER_CHUNK


def resolve(name: str | None) -> str:
    """Strategy for a configured name; unknown names fall back to recursive splitting."""
    upper = (name or "").upper()
    return upper if upper in STRATEGIES else RECURSIVE_CHARACTER_TEXT_SPLITTING


def label(name: str, sizes: ChunkSizes = ChunkSizes()) -> str:
    """Text stored in ``chunking_strategy``. Fixed values."""
    return {
        BY_PARAGRAPH: "By paragraph",
        BY_SENTENCE: "By sentence",
        BY_SENTENCE_WITH_SLIDING_WINDOW: f"By {sizes.sentences} sentences with a sliding window",
        EVERY_N_WORDS: f"Every {sizes.words} words",
        RECURSIVE_CHARACTER_TEXT_SPLITTING: "Recursive character text splitting with "
        f"chunk size = {sizes.characters} and chunk overlap = {sizes.overlap}",
    }.get(name, "Semantic chunking")


def resolve_column(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.isin(*STRATEGIES), upper).otherwise(
        F.lit(RECURSIVE_CHARACTER_TEXT_SPLITTING)
    )


def label_column(
    name: Column, characters: Column, overlap: Column, words: Column, sentences: Column
) -> Column:
    """``label`` with every parameter taken from a column."""
    return (
        F.when(name == BY_PARAGRAPH, F.lit("By paragraph"))
        .when(name == BY_SENTENCE, F.lit("By sentence"))
        .when(
            name == BY_SENTENCE_WITH_SLIDING_WINDOW,
            F.format_string("By %d sentences with a sliding window", sentences),
        )
        .when(name == EVERY_N_WORDS, F.format_string("Every %d words", words))
        .when(
            name == RECURSIVE_CHARACTER_TEXT_SPLITTING,
            F.format_string(
                "Recursive character text splitting with chunk size = %d and chunk overlap = %d",
                characters,
                overlap,
            ),
        )
        .otherwise(F.lit("Semantic chunking"))
    )


class StrategyMismatch(Exception):
    """The table holds chunks, but none made with a requested strategy."""


def stored_strategies(table: DataFrame) -> DataFrame:
    return table.select("chunking_strategy").distinct()


def missing_strategies(requested: DataFrame, table: DataFrame) -> DataFrame:
    """Requested labels the table does not hold; none when the table is empty."""
    stored = stored_strategies(table)
    wanted = requested.select("chunking_strategy").distinct()
    return wanted.where(table.select("chunking_strategy").exists()).join(
        stored, "chunking_strategy", "left_anti"
    )


def missing_strategies_except(requested: DataFrame, table: DataFrame) -> DataFrame:
    """The set form: labels requested minus labels stored; none when the table is empty."""
    wanted = requested.select("chunking_strategy").where(table.select("chunking_strategy").exists())
    return wanted.subtract(table.select("chunking_strategy"))


def labels_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    values = F.array(*[F.lit(x) for x in labels])
    return spark.range(1).select(F.explode(values).alias("chunking_strategy"))


def check_strategies(
    spark: SparkSession, table: DataFrame, labels: list[str], on_mismatch: str = "error"
) -> list[str]:
    """Labels new to a table that already holds others, handled as ``on_mismatch`` says.

    ``error`` raises, ``warn`` and ``ignore`` return them. The result is no longer than ``labels``.
    """
    requested = labels_frame(spark, labels)
    found = sorted(r[0] for r in missing_strategies(requested, table).collect())
    return _handled(found, on_mismatch)


def check_labels(labels: list[str], stored: set[str], on_mismatch: str = "error") -> list[str]:
    """``check_strategies`` for stored labels that are known, as from the folders of a table."""
    return _handled(sorted(set(labels) - stored) if stored else [], on_mismatch)


def _handled(found: list[str], on_mismatch: str) -> list[str]:
    if on_mismatch not in ("error", "warn", "ignore"):
        raise ValueError(f"unknown policy {on_mismatch!r}")
    if found and on_mismatch == "error":
        raise StrategyMismatch(
            f"the table holds other chunking strategies, but not {found}; mixing them "
            "changes retrieval. Use a stored one, another table, or on_mismatch='warn'"
        )
    if found and on_mismatch == "warn":
        import warnings

        warnings.warn(f"chunking strategies new to this table: {found}", stacklevel=2)
    return found

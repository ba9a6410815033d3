"""Conversations: parsing, appending, trimming to a token budget, contexts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks import schema
from passageworks.functions.text import strip
from passageworks.session import shared_folder

TURNS_PER_BLOCK = 1024
CUTS_SENT = 1 << 20  # conversations, some 16 MB


def classify(message: Column) -> Column:
    """``role, text`` of one message of a history file, null when it has neither prefix.

    Every occurrence of the prefix is removed, not only the leading one.
    """
    text = strip(message)

    def spoken(role: str, prefix: str) -> Column:
        return F.struct(
            F.lit(role).alias("role"), F.replace(text, F.lit(prefix), F.lit("")).alias("text")
        )

    return F.when(
        text.startswith(schema.USER_PREFIX), spoken("user", schema.USER_PREFIX)
    ).when(
        text.startswith(schema.ASSISTANT_PREFIX), spoken("assistant", schema.ASSISTANT_PREFIX)
    )


def parse_history(
    files: DataFrame, text: str = "text", separator: str = schema.HISTORY_SEPARATOR
) -> DataFrame:
    """Messages of history texts held in a column: ``part`` is the place within the text."""
    kept = [c for c in files.columns if c != text]
    return (
        files.select(
            *kept, F.posexplode(F.split(text, f"\\Q{separator}\\E", -1)).alias("part", "_message")
        )
        .withColumn("_spoken", classify(F.col("_message")))
        .filter("_spoken is not null")
        .select(*kept, "part", "_spoken.role", "_spoken.text")
    )


def render_message(
    role: Column, text: Column, separator: str = schema.HISTORY_SEPARATOR
) -> Column:
    """The lines a turn adds to a history file; other roles than user and assistant add none."""
    prefix = F.when(role == "user", schema.USER_PREFIX).when(
        role == "assistant", schema.ASSISTANT_PREFIX
    )
    return F.coalesce(F.concat(F.lit(separator + "\n"), prefix, text, F.lit("\n")), F.lit(""))


def append_turns(history: DataFrame, new: DataFrame) -> DataFrame:
    """``history`` plus ``new`` (``conv_id, position, role, text``) behind the last turns."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    numbered = new.join(last, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("_last", F.lit(-1)) + F.col("position")).cast("long").alias("turn"),
        "role",
        "text",
    )
    return history.select("conv_id", "turn", "role", "text").unionByName(numbered)


def count_words(text: Column) -> Column:
    """Default token count: words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def history_cuts(
    messages: DataFrame,
    max_tokens: int = schema.MAX_TOKENS,
    tokens: Column | None = None,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """``conv_id, from_turn``: the user message with which what fits the budget begins.

    Of the messages only ids, turns and numbers of tokens are shuffled. They are weighed in blocks of
    turns, and only the blocks near a conversation's end are looked into turn by turn. Turns with the
    same number stay together. A conversation of which no user message fits has no row.
    """
    cost = count_words(F.col("text")) if tokens is None else tokens
    system = _is_system()
    turns = messages.filter("turn IS NOT NULL").select(
        F.struct("conv_id").alias("_key"),  # never null, so a null id is a conversation like any other
        "turn",
        F.floor(F.col("turn") / turns_per_block).alias("_block"),
        F.when(system, 0).otherwise(F.coalesce(cost.cast("long"), F.lit(0))).alias("_tokens"),
        F.when(system, F.coalesce(cost.cast("long"), F.lit(0))).otherwise(0).alias("_reserved"),
        F.coalesce((F.col("role") == "user") & ~system, F.lit(False)).alias("_user"),
    )
    # Newest first: tokens in later blocks, without the system message.
    blocks = turns.groupBy("_key", "_block").agg(
        F.sum("_tokens").alias("_in_block"), F.sum("_reserved").alias("_reserved")
    )
    newest = Window.partitionBy("_key").orderBy(F.desc("_block"))
    newer = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near_end = blocks.select(
        "_key",
        "_block",
        (F.sum("_in_block").over(newer) - F.col("_in_block")).alias("_later"),
        (max_tokens - F.sum("_reserved").over(Window.partitionBy("_key"))).alias("_budget"),
    ).filter("_later <= _budget")
    later = (
        Window.partitionBy("_key", "_block")
        .orderBy(F.desc("turn"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fitting = turns.join(near_end, ["_key", "_block"]).withColumn(
        "_used", F.col("_later") + F.sum("_tokens").over(later)
    )
    return (
        fitting.filter("_used <= _budget AND _user")
        .groupBy("_key")
        .agg(F.min("turn").alias("from_turn"))
        .select("_key.conv_id", "from_turn")
    )


def _is_system() -> Column:
    return F.coalesce((F.col("role") == "system") & (F.col("turn") == 0), F.lit(False))


def trim_history(
    messages: DataFrame,
    max_tokens: int = schema.MAX_TOKENS,
    tokens: Column | None = None,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """The last whole messages that fit the budget, starting on a user message.

    A system message at turn 0 is kept and uses up budget first. Texts stay where they are until
    ``history_cuts`` has found where each conversation begins: one number for each, sent to the tasks
    up to CUTS_SENT conversations, and joined by shuffle beyond. Messages of a null ``conv_id`` are
    one conversation, messages without a turn are left out, and turns without tokens cost nothing.
    """
    cuts = history_cuts(messages, max_tokens, tokens, turns_per_block)
    path = shared_folder(messages.sparkSession, "cuts")
    cuts.write.parquet(path)
    cuts = messages.sparkSession.read.schema(cuts.schema).parquet(path)
    cuts = cuts.select(F.struct("conv_id").alias("_key"), "from_turn")
    cuts = F.broadcast(cuts) if cuts.count() <= CUTS_SENT else cuts
    joined = messages.withColumn("_key", F.struct("conv_id")).join(cuts, "_key", "left")
    kept = _is_system() | (F.col("turn") >= F.col("from_turn"))
    return joined.filter(kept).select(*messages.columns)


def assemble_context(ranked: DataFrame) -> DataFrame:
    """``qid, context``: the ranked chunks of a question, a blank line after each."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "chunk_content")))
    chunks = F.transform(in_order, lambda x: x["chunk_content"])
    return ranked.groupBy("qid").agg(
        F.concat(F.array_join(chunks, "\n\n"), F.lit("\n\n")).alias("context")
    )


def assemble_prompts(
    trimmed: DataFrame, contexts: DataFrame, template: str, key: str = "conv_id"
) -> DataFrame:
    """``key, prompt``: the template with its ``{context}``, then ``role: text`` per message.

    ``trimmed`` has at most a budget's worth of messages per conversation. A conversation without
    context gets an empty one.
    """
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talk = F.array_join(
        F.transform(in_order, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n"
    )
    messages = trimmed.groupBy(key).agg(talk.alias("_talk"))
    context = F.coalesce("context", F.lit(""))
    system = F.replace(F.lit(template), F.lit("{context}"), context)
    return messages.join(contexts, key, "left").select(
        key, F.concat(system, F.lit("\n"), F.col("_talk")).alias("prompt")
    )


def message_stats(messages: DataFrame) -> DataFrame:
    """Number and length of the messages of each role."""
    length = F.char_length("text")
    return messages.groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(length).alias("characters"),
        F.max(length).alias("longest"),
    )

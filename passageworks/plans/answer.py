"""Questions to prompts: retrieval, context, trimmed history and the prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks import schema
from passageworks.functions.text import strip
from passageworks.operators import history as hi
from passageworks.operators.embedding import Embedder, embed_questions
from passageworks.operators.search import vector_search_batch


def prompts(
    table: DataFrame,
    questions: DataFrame,
    history: DataFrame,
    embedder: Embedder,
    template: str,
    strategy: str | None = None,
    k: int = schema.TOP_K,
    metric: str = "cosine_similarity",
    is_customer: bool = True,
    max_tokens: int = schema.MAX_TOKENS,
) -> DataFrame:
    """``conv_id, prompt`` for one new question per conversation.

    ``questions`` has ``conv_id, question``; blank ones are dropped. The question becomes the
    last user turn of its conversation before the history is trimmed.
    """
    asked = questions.withColumn("question", strip(F.col("question"))).filter("question <> ''")
    with_vectors = embed_questions(asked, embedder).select(
        F.col("conv_id").alias("qid"), "embedding"
    )
    ranked = vector_search_batch(
        table, with_vectors, k, metric, strategy, embedder.name, is_customer
    )
    contexts = hi.assemble_context(ranked).withColumnRenamed("qid", "conv_id")
    new = asked.select(
        "conv_id",
        F.lit(1).alias("position"),
        F.lit("user").alias("role"),
        F.col("question").alias("text"),
    )
    talks = hi.append_turns(history.join(asked.select("conv_id"), "conv_id", "left_semi"), new)
    return hi.assemble_prompts(hi.trim_history(talks, max_tokens), contexts, template)

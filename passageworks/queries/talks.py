"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import strip
from passageworks.operators import history as hi
from passageworks.plans.answer import prompts
from passageworks.queries import inputs as inp
from passageworks.queries.registry import query
from passageworks.queries.vectors import BATCH_SQL
from passageworks.schema import HISTORY_SEPARATOR


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.read(spark, sf_dir, "conversations")


@query(
    "history_parse",
    """WITH lines AS (
  SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))
SELECT conv_id, turn, (i + 1)::INT AS part, CASE i % 3 WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
  trim(line, ' ' || chr(9)) || CASE i % 3 WHEN 0 THEN ' again' ELSE '' END AS text
FROM lines WHERE i % 3 < 2 AND trim(line, ' ' || chr(9)) <> ''""",
)
def history_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a history text of its own: its lines spoken by user, AI and nobody in turn."""
    line = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.concat(
            F.lit(HISTORY_SEPARATOR + "\n"),
            F.when(i % 3 == 0, F.concat(F.lit("User: "), x, F.lit(" User: again")))
            .when(i % 3 == 1, F.concat(F.lit("AI: "), x))
            .otherwise(F.concat(F.lit("Note: "), x)),
            F.lit("\n"),
        ),
    )
    texts = _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(line, "").alias("text"))
    return hi.parse_history(texts)


@query(
    "history_append",
    """WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, last + 1, 'user', 'And number ' || conv_id || '?' FROM last
UNION ALL SELECT conv_id, last + 2, 'assistant', 'Yes.' FROM last""",
)
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _turns(spark, sf_dir)
    said = F.array(
        F.struct(
            F.lit(1).alias("position"),
            F.lit("user").alias("role"),
            F.concat(F.lit("And number "), F.col("conv_id").cast("string"), F.lit("?")).alias(
                "text"
            ),
        ),
        F.struct(
            F.lit(2).alias("position"), F.lit("assistant").alias("role"), F.lit("Yes.").alias("text")
        ),
    )
    new = history.select("conv_id").distinct().select("conv_id", F.inline(said))
    return hi.append_turns(history, new)


def _trim_sql(source: str, budget: int) -> str:
    return f"""cost AS (
  SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n
  FROM {source}),
budget AS (
  SELECT conv_id, {budget} - coalesce(sum(n) FILTER (role = 'system'), 0) AS budget
  FROM cost GROUP BY conv_id),
used AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC
    ROWS UNBOUNDED PRECEDING) AS used FROM cost WHERE role <> 'system'),
fit AS (SELECT used.* FROM used JOIN budget USING (conv_id) WHERE used <= budget),
first AS (SELECT conv_id, min(turn) AS first FROM fit WHERE role = 'user' GROUP BY conv_id),
kept AS (
  SELECT conv_id, turn, role, text FROM fit JOIN first USING (conv_id) WHERE turn >= first
  UNION ALL SELECT conv_id, turn, role, text FROM cost WHERE role = 'system'),
talk AS (
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS talk
  FROM kept GROUP BY conv_id)
"""


_TRIM_SQL = "WITH " + _trim_sql("conversations", 200)


@query("history_trim", _TRIM_SQL + "SELECT * FROM kept")
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.trim_history(_turns(spark, sf_dir), 200)


TEMPLATE = "Answer from the context only.\nContext:\n{context}\nEnd of context."
_TEMPLATE_SQL = " || chr(10) || ".join(f"'{line}'" for line in TEMPLATE.split("\n"))


@query(
    "assemble_prompt",
    _TRIM_SQL
    + f"""SELECT talk.conv_id, replace({_TEMPLATE_SQL}, '{{context}}', coalesce(b.text, ''))
  || chr(10) || talk AS prompt
FROM talk LEFT JOIN benchmark b ON b.item_id = conv_id""",
)
def assemble_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passage with the conversation's number is its context."""
    contexts = inp.read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("conv_id"), F.col("text").alias("context")
    )
    trimmed = hi.trim_history(_turns(spark, sf_dir), 200)
    return hi.assemble_prompts(trimmed, contexts, TEMPLATE)


@query(
    "message_stats",
    """SELECT role, count(*) AS messages, sum(length(text))::BIGINT AS characters,
  max(length(text))::INT AS longest FROM conversations GROUP BY role""",
)
def message_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.message_stats(_turns(spark, sf_dir))


@query(
    "filter_blank_questions",
    """SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10)) AS question
FROM conversations WHERE role <> 'system' AND trim(text, ' ' || chr(9) || chr(10)) <> ''""",
)
def filter_blank_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns are turned into white space of several kinds; no question is left of them."""
    blank = F.lit(" \t\n\u000b\u001c\u001f\u0085  　")
    asked = F.when(F.col("role") == "system", blank).otherwise(F.col("text"))
    question = strip(asked)
    return _turns(spark, sf_dir).select("conv_id", "turn", question.alias("question")).filter(
        "question <> ''"
    )


@query(
    "render_history",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN repeat('-', 15) || chr(10) || 'User: '
  || text || chr(10) WHEN 'assistant' THEN repeat('-', 15) || chr(10) || 'AI: ' || text || chr(10)
  ELSE '' END AS lines FROM conversations""",
)
def render_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", hi.render_message(F.col("role"), F.col("text")).alias("lines")
    )


@query(
    "answer_prompts",
    BATCH_SQL
    + f""", context AS (
  SELECT qid AS conv_id, string_agg(chunk_content, chr(10) || chr(10) ORDER BY rank)
    || chr(10) || chr(10) AS context FROM ranked WHERE rank <= 10 GROUP BY qid),
last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
grown AS (
  SELECT conv_id, turn, role, text FROM conversations
  WHERE conv_id IN (SELECT item_id FROM benchmark)
  UNION ALL SELECT item_id, coalesce(last, -1) + 1, 'user', trim(text, ' ' || chr(10))
  FROM benchmark LEFT JOIN last ON conv_id = item_id),
{_trim_sql('grown', 400)}
SELECT talk.conv_id, replace({_TEMPLATE_SQL}, '{{context}}', coalesce(context, ''))
  || chr(10) || talk AS prompt
FROM talk LEFT JOIN context USING (conv_id)""",
)
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from a question in a conversation to the prompt of a model."""
    questions = inp.read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("conv_id"), F.col("text").alias("question")
    )
    return prompts(
        inp.vector_table(spark, sf_dir),
        questions,
        _turns(spark, sf_dir),
        inp.MODEL,
        TEMPLATE,
        max_tokens=400,
    )

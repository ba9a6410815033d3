"""Chunking queries. A chunk is compared by its hash, place and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import sha256_hex
from passageworks.operators import chunking as ch
from passageworks.operators import strategies as st
from passageworks.queries import inputs as inp
from passageworks.queries.registry import query


def _chunks(documents: DataFrame, made: Column) -> DataFrame:
    content = F.col("chunk_content")
    return ch.explode_chunks(documents.select("doc_id", made.alias("made")), "made").select(
        "doc_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        sha256_hex(content).alias("chunk_id"),
        F.char_length(content).cast("long").alias("n_chars"),
    )


_OUT = "doc_id, chunk_no, sha256(c) AS chunk_id, length(c)::BIGINT AS n_chars"
# One list per document to one row per chunk.
_EXPLODE = (
    f"SELECT {_OUT} FROM (SELECT doc_id, unnest(cs) AS c, "
    "generate_subscripts(cs, 1)::BIGINT - 1 AS chunk_no FROM made)"
)
# The engine has no look-behind, so the end of a sentence is marked and then split.
SENTENCES_SQL = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD_CHUNKS_SQL = (
    "list_transform(range(0, len({0}), 100), "
    "lambda i: trim(array_to_string({0}[i + 1 : i + 100], ' '), " + SPACE_SQL + "))"
)


def _with_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line break made a paragraph break of two or three line breaks."""
    return inp.read_documents(spark, sf_dir).select(
        "doc_id", F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(".\n\n"),
                            F.lit(".\n\n\n")).alias("text")
    )


@query(
    "chunk_paragraph",
    f"""WITH made AS (
  SELECT doc_id, string_split_regex(replace(replace(text, chr(10), chr(10) || chr(10)),
    '.' || chr(10) || chr(10), '.' || chr(10) || chr(10) || chr(10)), '\\n{{2,}}') AS cs
  FROM documents) {_EXPLODE}""",
)
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(_with_blank_lines(spark, sf_dir), ch.paragraphs(F.col("text")))


@query(
    "chunk_sentence",
    f"WITH made AS (SELECT doc_id, {SENTENCES_SQL.format('text')} AS cs FROM documents) {_EXPLODE}",
)
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(inp.read_documents(spark, sf_dir), ch.sentences(F.col("text")))


@query(
    "chunk_sentence_window",
    f"""WITH s AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM (
  SELECT doc_id, {SENTENCES_SQL.format('text')} AS cs FROM documents)),
w AS (SELECT doc_id, pos AS chunk_no,
        c || ' ' || lead(c, 1) OVER o || ' ' || lead(c, 2) OVER o AS c
      FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT {_OUT} FROM w WHERE c IS NOT NULL""",
)
def chunk_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(
        inp.read_documents(spark, sf_dir), ch.sentence_windows(F.col("text"), width=3)
    )


@query(
    "chunk_every_n_words",
    f"""WITH split AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
made AS (SELECT doc_id, {WORD_CHUNKS_SQL.format('ws')} AS cs FROM split) {_EXPLODE}""",
)
def chunk_every_n_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(inp.read_documents(spark, sf_dir), ch.every_n_words(F.col("text"), 100))


# Cut points of lines, or of the words of a line of 300 characters and more; then one chunk
# per step of the recursion: as many pieces as fit, and back by at most 50 characters.
_RECURSIVE_SQL = f"""WITH RECURSIVE split AS (
  SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
ends AS (
  SELECT *, (sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS e FROM split),
lines AS (
  SELECT *, e - length(s) - (i > 0)::INT AS b, length(s) + (i > 0)::INT >= 300 AS is_long FROM ends
  WHERE length(s) + (i > 0)::INT > 0),
numbered AS (
  SELECT *, sum(is_long::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
short_runs AS (
  SELECT doc_id, min(b) AS run_start, list_append(list(b ORDER BY b), max(e)) AS cuts
  FROM numbered WHERE NOT is_long GROUP BY doc_id, g),
words AS (
  SELECT doc_id, b, e, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j
  FROM (SELECT doc_id, b, e, string_split(CASE WHEN i > 0 THEN chr(10) ELSE '' END || s, ' ') AS ws
        FROM numbered WHERE is_long)),
starts AS (
  SELECT doc_id, b, e, greatest(b, b + (sum(length(w) + 1) OVER (
    PARTITION BY doc_id, b ORDER BY j))::BIGINT - length(w) - 2) AS c FROM words),
long_runs AS (
  SELECT doc_id, b AS run_start, list_append(list(DISTINCT c ORDER BY c), max(e)) AS cuts
  FROM starts GROUP BY doc_id, b),
runs AS (SELECT * FROM short_runs UNION ALL SELECT * FROM long_runs),
steps AS (
  SELECT doc_id, run_start, cuts, 1::BIGINT AS f,
         len(list_filter(cuts, lambda c: c <= cuts[1] + 300)) AS e FROM runs
  UNION ALL
  SELECT doc_id, run_start, cuts, f, len(list_filter(cuts, lambda c: c <= cuts[f] + 300)) AS e
  FROM (SELECT doc_id, run_start, cuts, greatest(f, least(e, 1 + len(list_filter(cuts,
          lambda c: c < greatest(cuts[e] - 50, cuts[e + 1] - 300))))) AS f
        FROM steps WHERE e < len(cuts))),
pieces AS (
  SELECT doc_id, run_start, f, trim(substring(text, cuts[f] + 1, cuts[e] - cuts[f]), ' ' || chr(10)) AS c
  FROM steps JOIN documents USING (doc_id)),
made AS (
  SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY run_start, f) - 1 AS chunk_no
  FROM pieces WHERE c <> '')
SELECT {_OUT} FROM made"""


@query("chunk_recursive", _RECURSIVE_SQL)
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(
        inp.read_documents(spark, sf_dir), ch.recursive_characters(F.col("text"), 300, 50)
    )


@query(
    "chunk_char_window",
    f"""WITH made AS (
  SELECT doc_id, list_transform(range(0, greatest(length(text) - 1 - 50, 0) + 1, 250),
                                lambda i: substring(text, i + 1, 300)) AS cs
  FROM documents) {_EXPLODE}""",
)
def chunk_char_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(
        inp.read_documents(spark, sf_dir), ch.character_windows(F.col("text"), 300, 50)
    )


_SEMANTIC_SQL = f"""WITH s AS (
  SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos
  FROM (SELECT doc_id, {SENTENCES_SQL.format('text')} AS cs FROM documents)),
g AS (
  SELECT doc_id, pos, concat_ws(' ', lag(c) OVER o, c, lead(c) OVER o) AS txt
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
words AS (
  SELECT doc_id, pos, unnest(string_split_regex(lower(txt), '[ \\t\\n\\v\\f\\r]+')) AS w FROM g),
n AS (
  SELECT doc_id, pos, ('0x' || left(md5(w), 8))::BIGINT % 64 AS b, count(*) AS n
  FROM words WHERE w <> '' GROUP BY ALL),
len AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS len FROM n GROUP BY ALL),
x AS (SELECT doc_id, pos, b, n / len AS x FROM n JOIN len USING (doc_id, pos)),
dots AS (
  SELECT a.doc_id, a.pos, sum(a.x * z.x) AS sim
  FROM x a JOIN x z ON a.doc_id = z.doc_id AND a.pos + 1 = z.pos AND a.b = z.b GROUP BY ALL),
step AS (
  SELECT s.doc_id, s.pos, round(1 - coalesce(sim, 0), 6) AS d
  FROM s LEFT JOIN dots USING (doc_id, pos)
  WHERE (s.doc_id, s.pos + 1) IN (SELECT (doc_id, pos) FROM s)),
bar AS (SELECT doc_id, round(quantile_cont(d, 0.95), 9) AS bar FROM step GROUP BY doc_id),
part AS (
  SELECT s.doc_id, s.pos, s.c,
         coalesce(sum(CASE WHEN step.d > bar.bar THEN 1 ELSE 0 END) OVER (
           PARTITION BY s.doc_id ORDER BY s.pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_no
  FROM s LEFT JOIN step USING (doc_id, pos) LEFT JOIN bar USING (doc_id)),
segment AS (
  SELECT doc_id, chunk_no, string_agg(c, ' ' ORDER BY pos) AS c FROM part GROUP BY ALL)
SELECT {_OUT} FROM segment"""


@query("chunk_semantic", _SEMANTIC_SQL)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(inp.read_documents(spark, sf_dir), ch.semantic(F.col("text"), inp.MODEL))


_MULTI = (st.BY_SENTENCE, st.BY_SENTENCE_WITH_SLIDING_WINDOW, st.EVERY_N_WORDS)


@query(
    "chunk_multi_strategy",
    f"""WITH split AS (
  SELECT doc_id, source, string_split(text, ' ') AS ws, {SENTENCES_SQL.format('text')} AS ss
  FROM documents),
made AS (
  SELECT doc_id, source, 'Every 100 words' AS s, {WORD_CHUNKS_SQL.format('ws')} AS cs FROM split
  UNION ALL SELECT doc_id, source, 'By sentence', ss FROM split
  UNION ALL SELECT doc_id, source, 'By 3 sentences with a sliding window',
    list_transform(range(0, len(ss) - 2), lambda i: array_to_string(ss[i + 1 : i + 3], ' '))
    FROM split)
SELECT doc_id, source AS repo_name, s AS chunking_strategy, chunk_no, sha256(c) AS chunk_id
FROM (SELECT doc_id, source, s, unnest(cs) AS c,
             generate_subscripts(cs, 1)::BIGINT - 1 AS chunk_no FROM made)""",
)
def chunk_multi_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inp.doc_files(spark, sf_dir).select("doc_id", "repo_name", "document_text")
    return ch.chunk_documents(documents, _MULTI).select(
        "doc_id",
        "repo_name",
        "chunking_strategy",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        "chunk_id",
    )


@query(
    "build_chunk_table",
    f"""WITH {inp.DOC_FILES},
split AS (SELECT *, string_split(document_text, ' ') AS ws FROM doc_files),
made AS (SELECT *, {WORD_CHUNKS_SQL.format('ws')} AS cs FROM split)
SELECT document_id, document_name, repo_name, internal_only,
       'Every 100 words' AS chunking_strategy, chunk_no, c AS chunk_content,
       sha256(c) AS chunk_id, '{inp.MODEL.name}' AS embedding_model,
       DATE '{inp.DATE}' AS date_generated
FROM (SELECT * EXCLUDE (cs), unnest(cs) AS c, generate_subscripts(cs, 1)::BIGINT - 1 AS chunk_no
      FROM made)""",
)
def build_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inp.doc_files(spark, sf_dir).drop("doc_id", "filepath")
    return ch.chunk_documents(documents, st.EVERY_N_WORDS).select(
        "document_id",
        "document_name",
        "repo_name",
        "internal_only",
        "chunking_strategy",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        "chunk_content",
        "chunk_id",
        F.lit(inp.MODEL.name).alias("embedding_model"),
        F.to_date(F.lit(inp.DATE)).alias("date_generated"),
    )

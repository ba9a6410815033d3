"""Embedding, metric and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import is_blank
from passageworks.functions.vectors import METRICS, flatten_embedding, metric
from passageworks.operators import chunking as ch
from passageworks.operators import search as se
from passageworks.operators import strategies as st
from passageworks.operators.embedding import embed, embed_questions
from passageworks.operators.history import assemble_context
from passageworks.queries import inputs as inp
from passageworks.queries.chunks import WORD_CHUNKS_SQL
from passageworks.queries.registry import query

_SQL_METRIC = {
    "cosine_similarity": "list_cosine_similarity({a}, {b})",
    "cosine_distance": "1 - list_cosine_similarity({a}, {b})",
    "euclidean_distance": "list_distance({a}, {b})",
    "inner_product": "list_inner_product({a}, {b})",
    "manhattan_distance": "list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))",
    "squared_euclidean_distance": "list_sum(list_transform(list_zip({a}, {b}), "
    "lambda t: (t[1] - t[2]) * (t[1] - t[2])))",
}


def _score_sql(name: str, a: str, b: str) -> str:
    return f"round({_SQL_METRIC[name].format(a=a, b=b)}, 9)"


_KEY = {
    "euclidean_distance": "metric_euclidean",
    "manhattan_distance": "metric_manhattan",
    "squared_euclidean_distance": "metric_sq_euclidean",
}


def _register_metric(name: str) -> None:
    @query(
        _KEY.get(name, f"metric_{name}"),
        f"""WITH {inp.QUESTION_VECTOR}
SELECT vec_id, {_score_sql(name, 'e.embedding::DOUBLE[]', 'q.v')} AS score
FROM embeddings e, q_dense q""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = F.lit(inp.question_vector())
        score = metric(name, F.col("embedding"), asked)
        return inp.read(spark, sf_dir, "embeddings").select(
            "vec_id", F.round(score, 9).alias("score")
        )


for _name in METRICS:
    _register_metric(_name)


def _search_sql(name: str, where: str, table: str = "vector_table") -> str:
    order = "DESC" if METRICS[name] else "ASC"
    return f"""WITH {inp.VECTOR_TABLE}, {inp.QUESTION_VECTOR}
SELECT DISTINCT chunk_content, {_score_sql(name, 't.v', 'q.v')} AS score, document_name
FROM {table} t, q_dense q WHERE {where}
ORDER BY score {order}, chunk_content, document_name LIMIT 10"""


@query(
    "vector_scan_filtered",
    f"""WITH {inp.VECTOR_TABLE}
SELECT chunk_content, document_name,
  array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',') AS embedding
FROM vector_table
WHERE chunking_strategy = 'By sentence' AND embedding_model = '{inp.MODEL.name}'
  AND NOT internal_only""",
)
def vector_scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = se.searchable(inp.vector_table(spark, sf_dir), "By sentence", inp.MODEL.name)
    return seen.withColumn("embedding", inp.vector_text(F.col("embedding")))


@query(
    "vector_search_customer",
    _search_sql(
        "cosine_similarity", "chunking_strategy = 'By sentence' AND NOT internal_only"
    ),
)
def vector_search_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.vector_search(
        inp.vector_table(spark, sf_dir), inp.question_vector(), strategy="By sentence"
    )


@query(
    "vector_search_employee",
    _search_sql("euclidean_distance", "chunking_strategy = 'By sentence'"),
)
def vector_search_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.vector_search(
        inp.vector_table(spark, sf_dir),
        inp.question_vector(),
        metric="euclidean_distance",
        strategy="By sentence",
        is_customer=False,
    )


def _register_search(name: str) -> None:
    @query(f"vector_search_{name}", _search_sql(name, "chunking_strategy = 'By sentence' AND NOT internal_only"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return se.vector_search(
            inp.vector_table(spark, sf_dir), inp.question_vector(), metric=name, strategy="By sentence",
            model=inp.MODEL.name,
        )


for _name in ("cosine_distance", "manhattan_distance", "squared_euclidean_distance"):
    _register_search(_name)


@query(
    "vector_search_distinct",
    _search_sql(
        "inner_product",
        "NOT internal_only",
        "(SELECT * FROM vector_table UNION ALL SELECT * FROM vector_table)",
    ),
)
def vector_search_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table into which the same rows were appended twice."""
    table = inp.vector_table(spark, sf_dir)
    return se.vector_search(
        table.unionByName(table), inp.question_vector(), metric="inner_product"
    )


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question."""
    questions = inp.read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )
    return embed_questions(questions, inp.MODEL)


_ASKED_SQL = inp.sparse_vectors("q", "SELECT item_id AS id, text AS txt FROM benchmark")

BATCH_SQL = f"""WITH {inp.VECTOR_TABLE}, {_ASKED_SQL}, {inp.dense_vector('q')},
pairs AS (
  SELECT DISTINCT q.id AS qid, chunk_content, document_name,
         {_score_sql('cosine_similarity', 't.v', 'q.v')} AS score
  FROM vector_table t, q_dense q WHERE NOT internal_only),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, chunk_content, document_name)::INT AS rank FROM pairs)
"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Small blocks, so that the questions make several.
    return se.vector_search_batch(inp.vector_table(spark, sf_dir), _asked(spark, sf_dir), bytes_per_block=4096)


@query(
    "vector_search_batch",
    BATCH_SQL + "SELECT qid, rank, chunk_content, round(score, 3) AS score, document_name "
    "FROM ranked WHERE rank <= 10",
)
def vector_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).withColumn("score", F.round("score", 3))


@query(
    "assemble_context",
    BATCH_SQL + "SELECT qid, string_agg(chunk_content, chr(10) || chr(10) ORDER BY rank) "
    "|| chr(10) || chr(10) AS context FROM ranked WHERE rank <= 10 GROUP BY qid",
)
def assemble_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_context(_batch(spark, sf_dir))


_VECTOR_TEXT_SQL = (
    "array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',')"
)


@query(
    "embed_questions",
    f"""WITH {_ASKED_SQL}, {inp.dense_vector('q')}
SELECT id AS qid, len(v)::BIGINT AS dim, {_VECTOR_TEXT_SQL} AS vector FROM q_dense""",
)
def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select(
        "qid",
        F.size("embedding").cast("long").alias("dim"),
        inp.vector_text(F.col("embedding")).alias("vector"),
    )


_DOC_CHUNKS_SQL = f"""split AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
made AS (SELECT doc_id, {WORD_CHUNKS_SQL.format('ws')} AS cs FROM split),
chunks AS (
  SELECT doc_id, chunk_no, c, doc_id * 100000 + chunk_no AS id
  FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1)::BIGINT - 1 AS chunk_no
        FROM made)
  WHERE NOT regexp_full_match(c, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'))"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inp.read_documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "document_name"
        ),
        F.col("text").alias("document_text"),
    )
    return ch.chunk_documents(documents, st.EVERY_N_WORDS).filter(~is_blank(F.col("chunk_content")))


@query(
    "embed_chunks",
    f"""WITH {_DOC_CHUNKS_SQL},
{inp.sparse_vectors('c', 'SELECT id, c AS txt FROM chunks')}, {inp.dense_vector('c')}
SELECT doc_id, chunk_no, '{inp.MODEL.name}' AS embedding_model, {_VECTOR_TEXT_SQL} AS vector
FROM chunks JOIN c_dense USING (id)""",
)
def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select(
        "doc_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.lit(inp.MODEL.name).alias("embedding_model"),
        inp.vector_text(embed(F.col("chunk_content"), inp.MODEL)).alias("vector"),
    )


@query(
    "top_passages",
    f"""WITH {_DOC_CHUNKS_SQL},
{inp.sparse_vectors('c', 'SELECT id, c AS txt FROM chunks')},
{_ASKED_SQL},
cn AS (SELECT id, sqrt(sum(x * x)) AS len FROM c GROUP BY id),
qn AS (SELECT id, sqrt(sum(x * x)) AS len FROM q GROUP BY id),
dots AS (
  SELECT q.id AS qid, c.id, sum(q.x * c.x) AS dot FROM q JOIN c USING (b) GROUP BY ALL),
scored AS (
  SELECT DISTINCT qid, c AS chunk_content, 'doc' || doc_id || '.txt' AS document_name,
         round(dot / (cn.len * qn.len), 9) AS score
  FROM dots JOIN cn ON cn.id = dots.id JOIN qn ON qn.id = qid JOIN chunks ON chunks.id = dots.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, chunk_content, document_name)::INT AS rank FROM scored)
SELECT qid, rank, chunk_content, score, document_name FROM ranked WHERE rank <= 10""",
)
def top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark question the ten best 100-word passages of all documents."""
    table = _passages(spark, sf_dir).select(
        "chunk_content",
        "document_name",
        embed(F.col("chunk_content"), inp.MODEL).alias("embedding"),
    )
    return se.vector_search_batch(table, _asked(spark, sf_dir), is_customer=False)


@query(
    "flatten_embedding",
    """SELECT vec_id, len(embedding)::BIGINT AS dim,
       array_to_string(list_transform(embedding,
         lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',') AS vector
FROM embeddings""",
)
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")
    nested = F.array(F.slice(vector, 1, 32), F.slice(vector, F.lit(33), F.size(vector)))
    flat = flatten_embedding(nested)
    return inp.read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(flat).cast("long").alias("dim"),
        inp.vector_text(flat).alias("vector"),
    )

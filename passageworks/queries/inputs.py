"""Inputs derived from the given tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import basename, sha256_hex
from passageworks.operators.embedding import HashedWords, embed_question
from passageworks.sources.spread import spread

MODEL = HashedWords(64)
QUESTION = "which of the two is there and why"
DATE = "2024-06-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, over enough tasks for the work that follows on each."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def question_vector() -> list[float]:
    return embed_question(QUESTION, MODEL)


def vector_text(vector: Column) -> Column:
    """A vector as text, in millionths, for comparison across engines."""
    return F.array_join(
        F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")),
        ",",
    )


# ---------------------------------------------------------------- documents as files


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of repositories: type by language, repository by source."""
    suffix = (
        F.when(F.col("lang") == "en", ".md")
        .when(F.col("lang") == "fr", ".txt")
        .when(F.col("lang") == "de", ".docx")
        .otherwise(".MD")
    )
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return (
        read_documents(spark, sf_dir)
        .select("doc_id", path.alias("filepath"), "source", F.col("text").alias("document_text"))
        .select(
            "doc_id",
            "filepath",
            sha256_hex(F.col("filepath")).alias("document_id"),
            basename(F.col("filepath")).alias("document_name"),
            F.col("source").alias("repo_name"),
            F.col("source").isin("src1", "src8", "src15").alias("internal_only"),
            "document_text",
        )
    )


DOC_FILES = """doc_files AS (
  SELECT doc_id, filepath, sha256(filepath) AS document_id,
         string_split(filepath, '/')[-1] AS document_name, source AS repo_name,
         source IN ('src1', 'src8', 'src15') AS internal_only, text AS document_text
  FROM (SELECT doc_id, source, text,
               '/corpus/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md'
                 WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.docx' ELSE '.MD' END AS filepath
        FROM documents))"""


# ---------------------------------------------------------------- vectors


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as stored chunks: strategy, file and access by label."""
    label = F.col("label")
    strategy = (
        F.when(label < 4, "Every 100 words").when(label < 7, "By sentence").otherwise("By paragraph")
    )
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("passage "), (F.col("vec_id") % 400).cast("string")).alias("chunk_content"),
        F.concat(F.lit("file"), label.cast("string"), F.lit(".md")).alias("document_name"),
        strategy.alias("chunking_strategy"),
        F.lit(MODEL.name).alias("embedding_model"),
        label.isin(3, 6).alias("internal_only"),
        "embedding",
    )


VECTOR_TABLE = f"""vector_table AS (
  SELECT vec_id, 'passage ' || (vec_id % 400) AS chunk_content,
         'file' || label || '.md' AS document_name,
         CASE WHEN label < 4 THEN 'Every 100 words' WHEN label < 7 THEN 'By sentence'
              ELSE 'By paragraph' END AS chunking_strategy,
         '{MODEL.name}' AS embedding_model, label IN (3, 6) AS internal_only,
         embedding::DOUBLE[] AS v
  FROM embeddings)"""


def sparse_vectors(name: str, source: str, dim: int = 64) -> str:
    """SQL for hashed word vectors of ``source(id, txt)``: rows ``id, b, x`` of ``name``."""
    return f"""{name}_words AS (
  SELECT id, unnest(string_split_regex(lower(txt), '[ \\t\\n\\v\\f\\r]+')) AS w FROM ({source})),
{name}_counts AS (
  SELECT id, (('0x' || left(md5(w), 8))::BIGINT % {dim})::INT AS b, count(*) AS n
  FROM {name}_words WHERE w <> '' GROUP BY ALL),
{name} AS (
  SELECT id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x
  FROM {name}_counts)"""


def dense_vector(name: str, dim: int = 64) -> str:
    """SQL for ``id, v DOUBLE[]`` from the sparse rows of ``name``."""
    slots = ", ".join(f"coalesce(max(x) FILTER (b = {b}), 0)" for b in range(dim))
    return f"{name}_dense AS (SELECT id, [{slots}] AS v FROM {name} GROUP BY id)"


QUESTION_VECTOR = (
    sparse_vectors("q", f"SELECT 0 AS id, '{QUESTION}' AS txt") + ",\n" + dense_vector("q")
)

# ---------------------------------------------------------------- change log


def commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a repository: one commit per event, one path per user."""
    kind = F.col("event_type")
    change = (
        F.when(kind == "error", "D").when(kind == "signup", "A").when(kind == "view", "R")
        .otherwise("M")
    )
    return read(spark, sf_dir, "events").select(
        sha256_hex(F.col("event_id").cast("string")).alias("commit_hash"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "dev").otherwise("main").alias("branch"),
        change.alias("change_type"),
        F.concat(F.lit("docs/"), (F.col("user_id") + 1).cast("string"), F.lit(".md")).alias(
            "old_path"
        ),
        F.concat(F.lit("docs/"), F.col("user_id").cast("string"), F.lit(".md")).alias("new_path"),
    )


COMMIT_CHANGES = """commit_changes AS (
  SELECT sha256(event_id::VARCHAR) AS commit_hash, event_id AS seq,
         CASE WHEN event_type = 'click' THEN 'dev' ELSE 'main' END AS branch,
         CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'A' WHEN 'view' THEN 'R'
              ELSE 'M' END AS change_type,
         'docs/' || (user_id + 1) || '.md' AS old_path, 'docs/' || user_id || '.md' AS new_path
  FROM events)"""


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filepath"),
        F.col("source").alias("repo_name"),
        F.col("text").alias("document_text"),
    )


REPO_FILES = """repo_files AS (
  SELECT 'docs/' || doc_id || '.md' AS filepath, source AS repo_name, text AS document_text
  FROM documents)"""
LATEST = """latest AS (
  SELECT new_path AS path, arg_max(commit_hash, seq) AS document_version
  FROM commit_changes WHERE change_type <> 'D' AND branch = 'main' GROUP BY new_path)"""

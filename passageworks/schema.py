"""Column names, the stored vector table and the default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_TABLE = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("document_name", T.StringType(), False),
        T.StructField("document_version", T.StringType(), False),
        T.StructField("repo_name", T.StringType(), False),
        T.StructField("chunk_content", T.StringType(), False),
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("chunking_strategy", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("embedding_model", T.StringType(), False),
        T.StructField("date_generated", T.DateType(), False),
        T.StructField("internal_only", T.BooleanType(), False),
    ]
)

# Results depend on them.
ALLOWED_EXTENSIONS = (".docx", ".txt", ".md")
HISTORY_SEPARATOR = "-" * 15
USER_PREFIX = "User: "
ASSISTANT_PREFIX = "AI: "
CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
WORDS_PER_CHUNK = 100
SENTENCES_PER_CHUNK = 3
MAX_TOKENS = 3000
TOP_K = 10
DEFAULT_BATCH_SIZE = 100

# Row identity of a stored chunk; a second ingest of the same rows adds nothing, but a document's
# new version, or a change of its access flag, is stored next to the old one.
CHUNK_KEY = (
    "document_id", "document_version", "internal_only", "chunk_id", "chunking_strategy",
    "embedding_model",
)

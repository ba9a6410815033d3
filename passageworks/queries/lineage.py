"""Change log, versions, consistency and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.operators import chunking as ch
from passageworks.operators import lineage as li
from passageworks.operators import stats
from passageworks.operators import strategies as st
from passageworks.operators.embedding import reuse_embeddings, still_to_embed
from passageworks.operators.ordinal import assign_batches
from passageworks.operators.validation import null_counts
from passageworks.queries import inputs as inp
from passageworks.queries.chunks import SENTENCES_SQL, WORD_CHUNKS_SQL
from passageworks.queries.registry import query


def _name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's diff as text: a change, a rename, a copy and an empty line."""
    path = F.col("new_path")
    lines = F.concat_ws(
        "\n",
        F.concat_ws("\t", F.col("change_type"), path),
        F.concat_ws("\t", F.lit("R100"), F.col("old_path"), F.concat(F.lit("moved/"), path)),
        F.lit(""),
        F.concat_ws("\t", F.lit("C75"), F.col("old_path"), path),
        F.concat_ws("\t", F.lit("D"), F.col("old_path")),
    )
    return inp.commit_changes(spark, sf_dir).select("commit_hash", lines.alias("diff"))


@query(
    "parse_name_status",
    f"""WITH {inp.COMMIT_CHANGES}
SELECT commit_hash, change_type, new_path AS path FROM commit_changes WHERE change_type <> 'D'
UNION ALL SELECT commit_hash, 'R100', 'moved/' || new_path FROM commit_changes""",
)
def parse_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.parse_name_status(_name_status(spark, sf_dir))


_VERSIONED_SQL = f"""WITH {inp.COMMIT_CHANGES}, {inp.REPO_FILES}, {inp.LATEST},
versioned AS (SELECT f.*, document_version FROM repo_files f LEFT JOIN latest ON path = filepath)
"""


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = li.touched_paths(inp.commit_changes(spark, sf_dir), "main")
    return li.with_versions(inp.repo_files(spark, sf_dir), touched)


@query(
    "latest_version_per_file", _VERSIONED_SQL + "SELECT filepath, document_version FROM versioned"
)
def latest_version_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).select("filepath", "document_version")


@query(
    "latest_version_window",
    f"""WITH {inp.COMMIT_CHANGES}
SELECT new_path AS path, commit_hash AS document_version FROM commit_changes
WHERE change_type <> 'D' AND branch = 'main'
QUALIFY row_number() OVER (PARTITION BY new_path ORDER BY seq DESC) = 1""",
)
def latest_version_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = li.touched_paths(inp.commit_changes(spark, sf_dir), "main")
    return li.latest_versions_by_rank(touched)


# Every fifth commit is a merge: it changes one path and renames another, by its diff alone.
_MERGED_SQL = f"""WITH {inp.COMMIT_CHANGES}, {inp.REPO_FILES},
touched AS (
  SELECT commit_hash, seq, new_path AS path FROM commit_changes
  WHERE seq % 5 <> 0 AND change_type <> 'D' AND branch = 'main'
  UNION ALL SELECT commit_hash, seq, new_path FROM commit_changes
  WHERE seq % 5 = 0 AND change_type <> 'D' AND branch = 'main'
  UNION ALL SELECT commit_hash, seq, replace(new_path, 'docs/', 'docs/1') FROM commit_changes
  WHERE seq % 5 = 0 AND branch = 'main'),
latest AS (SELECT path, arg_max(commit_hash, seq) AS document_version FROM touched GROUP BY path)
SELECT filepath, document_version FROM repo_files LEFT JOIN latest ON path = filepath"""


@query("latest_version_with_merges", _MERGED_SQL)
def latest_version_with_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions from two logs; some files are touched by merges only."""
    changes = inp.commit_changes(spark, sf_dir)
    lines = F.concat_ws(
        "\n",
        F.concat_ws("\t", "change_type", "new_path"),
        F.concat_ws("\t", F.lit("R087"), "old_path", F.replace("new_path", F.lit("docs/"), F.lit("docs/1"))),
        F.concat_ws("\t", F.lit("D"), F.lit("docs/2.md")),
    )
    merges = changes.where("seq % 5 = 0").select("commit_hash", "seq", "branch", lines.alias("diff"))
    touched = li.all_touches(changes, merges, "main")
    return li.with_versions(inp.repo_files(spark, sf_dir), touched).select("filepath", "document_version")


@query(
    "ingest_counts",
    _VERSIONED_SQL
    + f"""SELECT repo_name, count(*) AS files,
  count(*) FILTER (document_version IS NULL) AS unversioned,
  sum(len({SENTENCES_SQL.format('document_text')}))::BIGINT AS chunks
FROM versioned GROUP BY repo_name""",
)
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _versioned(spark, sf_dir)
    chunks = ch.chunk_documents(
        files.select("repo_name", "document_text"), st.BY_SENTENCE
    )
    return stats.ingest_counts(files, chunks)


@query(
    "validate_not_null",
    _VERSIONED_SQL
    + """, blank AS (SELECT filepath, repo_name, document_version,
  CASE WHEN length(document_text) % 3 > 0 THEN document_text END AS chunk_content FROM versioned)
SELECT 'filepath' AS column_name, count(*) - count(filepath) AS null_count FROM blank
UNION ALL SELECT 'repo_name', count(*) - count(repo_name) FROM blank
UNION ALL SELECT 'document_version', count(*) - count(document_version) FROM blank
UNION ALL SELECT 'chunk_content', count(*) - count(chunk_content) FROM blank""",
)
def validate_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks; those of every third length are null."""
    some = F.when(F.char_length("document_text") % 3 > 0, F.col("document_text"))
    rows = _versioned(spark, sf_dir).withColumn("chunk_content", some)
    return null_counts(rows, ["filepath", "repo_name", "document_version", "chunk_content"])


# ---------------------------------------------------------------- strategies


def _requested(spark: SparkSession) -> DataFrame:
    return st.labels_frame(spark, [st.label(s) for s in st.STRATEGIES])


_REQUESTED_SQL = "requested(chunking_strategy) AS (VALUES {})".format(
    ", ".join(f"('{st.label(s)}')" for s in st.STRATEGIES)
)


@query(
    "distinct_strategies",
    f"WITH {inp.VECTOR_TABLE} SELECT DISTINCT chunking_strategy FROM vector_table",
)
def distinct_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stored_strategies(inp.vector_table(spark, sf_dir))


@query(
    "strategy_mismatch",
    f"""WITH {inp.VECTOR_TABLE}, {_REQUESTED_SQL}
SELECT chunking_strategy FROM requested
WHERE EXISTS (FROM vector_table)
  AND chunking_strategy NOT IN (SELECT chunking_strategy FROM vector_table)""",
)
def strategy_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.missing_strategies(_requested(spark), inp.vector_table(spark, sf_dir))


@query(
    "strategy_mismatch_except",
    f"""WITH {inp.VECTOR_TABLE}, {_REQUESTED_SQL}
SELECT chunking_strategy FROM requested EXCEPT SELECT chunking_strategy FROM vector_table""",
)
def strategy_mismatch_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.missing_strategies_except(_requested(spark), inp.vector_table(spark, sf_dir))


# ---------------------------------------------------------------- incremental embedding


def _keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inp.doc_files(spark, sf_dir).select(
        "document_id", "repo_name", "internal_only", "document_text"
    )
    return ch.chunk_documents(documents, st.EVERY_N_WORDS).withColumn(
        "embedding_model", F.lit(inp.MODEL.name)
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run embedded: the chunks of the internal repositories."""
    return _keyed_chunks(spark, sf_dir).filter("internal_only")


_KEYED_SQL = f"""WITH {inp.DOC_FILES},
split AS (SELECT *, string_split(document_text, ' ') AS ws FROM doc_files),
made AS (SELECT *, {WORD_CHUNKS_SQL.format('ws')} AS cs FROM split),
keyed AS (
  SELECT document_id, internal_only, chunk_no, sha256(c) AS chunk_id, length(c)::FLOAT AS n
  FROM (SELECT *, unnest(cs) AS c, generate_subscripts(cs, 1)::BIGINT - 1 AS chunk_no FROM made)),
stored AS (SELECT DISTINCT chunk_id, n FROM keyed WHERE internal_only)
"""


@query(
    "incremental_embed_todo",
    _KEYED_SQL
    + """SELECT document_id, chunk_no, chunk_id FROM keyed
WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)""",
)
def incremental_embed_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = still_to_embed(_keyed_chunks(spark, sf_dir), _stored(spark, sf_dir))
    return todo.select("document_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id")


@query(
    "incremental_embed_reuse",
    _KEYED_SQL
    + """SELECT document_id, chunk_no, chunk_id, stored.n::DOUBLE AS first_value
FROM keyed JOIN stored USING (chunk_id)""",
)
def incremental_embed_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of one number, the length of its chunk, shows which vector was taken."""
    length = F.char_length("chunk_content").cast("float")
    stored = _stored(spark, sf_dir).withColumn("embedding", F.array(length))
    return reuse_embeddings(_keyed_chunks(spark, sf_dir), stored).select(
        "document_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        "chunk_id",
        F.col("embedding")[0].cast("double").alias("first_value"),
    )


# ---------------------------------------------------------------- batches, shares, rates


@query(
    "assign_batches",
    """WITH numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n,
         count(*) OVER (PARTITION BY source) AS total FROM documents),
sized AS (SELECT *, CASE WHEN 40 > total THEN 100 ELSE 40 END AS size FROM numbered)
SELECT doc_id, source, ceil(n / size)::BIGINT AS batch_no,
       ceil(total / size)::BIGINT AS total_batches FROM sized""",
)
def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inp.read(spark, sf_dir, "documents").select("doc_id", "source")
    # Blocks of 100 ids: every source spans several at each scale factor.
    block = F.floor(F.col("doc_id") / 100)
    return assign_batches(documents, 40, ["source"], ["doc_id"], block)


@query(
    "share_of_total",
    """WITH parts AS (
  SELECT user_id, event_type, sum(value::DECIMAL(18, 2)) AS s FROM events GROUP BY ALL)
SELECT user_id, event_type, s::DOUBLE AS amount,
       round(s::DOUBLE * 100 / (sum(s) OVER (PARTITION BY user_id))::DOUBLE, 6) AS share
FROM parts""",
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event's share of its user's total, as a phase's share of a request."""
    amount = F.col("value").cast("decimal(18,2)")
    return stats.share_of_total(
        inp.read(spark, sf_dir, "events"), ["user_id", "event_type"], ["user_id"], amount
    ).withColumn("amount", F.col("amount").cast("double"))


@query(
    "throughput",
    """SELECT event_type, user_id, count(*) AS n_rows,
  round(CASE WHEN max(ts) = min(ts) THEN 0 ELSE count(*) * 1000000.0::DOUBLE
        / (epoch_us(max(ts)) - epoch_us(min(ts))) END, 6) AS rows_per_second
FROM events GROUP BY event_type, user_id""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.throughput(inp.read(spark, sf_dir, "events"), ["event_type", "user_id"], "ts")

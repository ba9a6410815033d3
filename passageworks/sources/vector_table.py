"""The stored vector table and the embedding cache."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import is_blank
from passageworks.operators.validation import table_columns
from passageworks.schema import CHUNK_KEY, VECTOR_TABLE
from passageworks.sources import table_log

# Retrieval filters on strategy and model, so these are the folders of the table, and within them
# the loads, which decide what a reader sees.
LAYOUT = ("chunking_strategy", "embedding_model")
_STORED = T.StructType([*VECTOR_TABLE, T.StructField("load", T.IntegerType())])
MOST_MARKS = 1 << 22  # hashes of states up to which they are sent to the tasks (32 MB)
FORMATS = ("parquet", "json")


def write_vector_table(
    df: DataFrame,
    path: str,
    rows_per_file: int = 0,
    mode: str = "append",
    compact: bool = False,
    load: int = 0,
) -> None:
    """Append rows: NOT NULL checked, chunks of mere white space left out.

    Rows of a ``load`` that has a number are seen once that load is committed; without one, at once.

    Each task writes its own rows, a file per folder, without a shuffle. ``compact`` is for
    loads of many small tasks: rows are gathered by folder first, and adaptive execution merges
    small shares and splits the folder that holds most rows.
    """
    rows = table_columns(df).filter(~is_blank(F.col("chunk_content")))
    if compact:
        rows = rows.hint("rebalance", *LAYOUT)
    (
        rows.withColumn("load", F.lit(load))
        .sortWithinPartitions(*LAYOUT, "date_generated", "document_id")
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .partitionBy(*LAYOUT, "load")
        .parquet(path)
    )


def read_vector_table(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows, those of former versions too."""
    rows = spark.read.schema(_STORED).parquet(path)
    loads = table_log.find_loads(spark, path)
    if loads is not None:
        rows = rows.where(loads.seen())
    return rows.select(*VECTOR_TABLE.fieldNames())


def rows_of_load(spark: SparkSession, path: str, load: int) -> DataFrame:
    """What one load wrote, committed or not."""
    rows = spark.read.schema(_STORED).parquet(path)
    return rows.where(F.col("load") == load).select(*VECTOR_TABLE.fieldNames())


def read_snapshot(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The rows that were valid after a load, the last one by default: what a search should see.

    Each document has the version and the access flag of that moment. Loads after it are pruned by
    their folders; rows that it found outdated are left out by a join with the few states that ever
    changed, which leaves the vectors where they are as long as these can be sent to the tasks.
    """
    loads = table_log.find_loads(spark, path)
    rows = spark.read.schema(_STORED).parquet(path)
    if loads is None:
        return rows.select(*VECTOR_TABLE.fieldNames())
    outdated = table_log.invalid_states(spark, path, loads, snapshot)
    valid = _by_states(rows.where(loads.seen(snapshot)), outdated, "left_anti")
    return valid.select(*VECTOR_TABLE.fieldNames())


def stored_labels(spark: SparkSession, path: str) -> set[str]:
    """The strategies a table holds, from the names of its folders: no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (f.getPath().getName() for f in listing if f.isDirectory())
    return {unquote(n.partition("=")[2]) for n in names if n.startswith(f"{LAYOUT[0]}=")}


def find_vector_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or nothing where no folder is."""
    try:
        return read_vector_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def only_new(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose key is not stored yet, so a second ingest adds nothing.

    Of the table only the key columns are read. The planner sends the smaller side's keys if they
    are small, and shuffles both by key if not.
    """
    keys = list(CHUNK_KEY)
    return chunks.join(table.select(*keys), keys, "left_anti")


def current_versions(table: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows of each document's newest version, with the access flag it has now.

    ``versions`` has one row per document: ``document_id, document_version, internal_only``.
    Rows of older versions, of documents that are not listed, and rows stored with another flag
    than the current one are left out, so a text that became internal is no longer found.
    """
    return _by_states(table, versions.select(*table_log.STATE), "left_semi").select(*table.columns)


def _by_states(rows: DataFrame, states: DataFrame, how: str) -> DataFrame:
    """A semi or anti join by document, version and flag that leaves rows where they are.

    Only hashes of the states are sent to the tasks. If a state of ``rows`` has the hash of one of
    ``states`` without being among them, or if these are too many, the states themselves are joined.
    """
    key = table_log.STATE
    marks = states.select(F.xxhash64(*key).alias("_mark"))
    if states.count() <= MOST_MARKS:
        marked = F.xxhash64(*key) == F.col("_mark")
        sent = F.broadcast(marks.distinct())
        if rows.select(*key).distinct().join(sent, marked, "left_semi").join(states, key, "left_anti").isEmpty():
            return rows.join(sent, marked, how)
    return rows.join(states, key, how)


def _known(file_format: str) -> str:
    name = file_format.lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported format {file_format!r}; one of {FORMATS}")
    return name


def save_embeddings(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write a cache of embedded chunks as parquet or as JSON lines with ISO dates."""
    writer = df.write.mode("overwrite")
    if _known(file_format) == "json":
        writer = writer.option("dateFormat", "yyyy-MM-dd")
    writer.format(_known(file_format)).save(path)


def load_embeddings(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Read a cache with the table's own schema; dates come back as dates."""
    reader = spark.read.schema(VECTOR_TABLE)
    if _known(file_format) == "json":
        reader = reader.option("dateFormat", "yyyy-MM-dd")
    return reader.format(_known(file_format)).load(path)

"""Corpus to vector table: versions, chunks, vectors, and an append of what is new."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import is_blank, local_root, repo_of, sha256_hex
from passageworks.operators import strategies as st
from passageworks.operators.chunking import chunk_documents
from passageworks.operators.embedding import VECTOR, Embedder, embed, embed_once
from passageworks.operators.lineage import all_touches, touched_paths, with_versions
from passageworks.schema import CHUNK_KEY
from passageworks.session import shared_folder
from passageworks.sources import key_store as ks
from passageworks.sources import table_log
from passageworks.sources import vector_table as vt
from passageworks.sources.files import read_documents
from passageworks.sources.folders import remove


HOT_TEXT = 10_000  # rows of one text in a load from which on they are not gathered in one task


@dataclass(frozen=True)
class Repo:
    """A folder of documents below the corpus root."""

    name: str
    main_branch: str = "main"
    internal_only: bool = False


def with_identity(files: DataFrame, touched: DataFrame, root: str) -> DataFrame:
    """Files with ``document_id`` (hash of the path), ``repo_name`` and ``document_version``.

    A file that no commit touched has a null version, which the NOT NULL check of the table
    refuses; filter such files out or give them a version before an ingest.
    """
    path = F.col("filepath")
    return with_versions(files, touched).withColumns(
        {"document_id": sha256_hex(path), "repo_name": repo_of(path, root)}
    )


def read_corpus(
    spark: SparkSession,
    root: str,
    repos: Sequence[Repo],
    changes: DataFrame,
    deny: Sequence[str] = (),
    merges: DataFrame | None = None,
    **how,
) -> DataFrame:
    """The documents of all repositories below ``root`` in one read, ready for ``ingest``.

    ``changes`` is the change log of all of them (``repo_name, commit_hash, seq, branch,
    change_type, new_path``); of each repository only its main branch counts. ``merges`` holds the
    merge commits (``repo_name, commit_hash, seq, branch``) with the name-status text ``diff`` of
    each to its first parent; files that only merges touched get their version from there.
    """
    root = root.rstrip("/")
    dimension = spark.createDataFrame(
        [(r.name, r.main_branch, r.internal_only) for r in repos],
        "repo_name string, branch string, internal_only boolean",
    )
    files = read_documents(spark, [f"{root}/{r.name}" for r in repos], deny=deny, **how)
    main = dimension.select("repo_name", "branch")
    folder = F.concat(F.lit(local_root(root) + "/"), "repo_name")
    on_main = changes.join(main, ["repo_name", "branch"])
    if merges is None:
        touched = touched_paths(on_main, folder=folder)
    else:
        touched = all_touches(on_main, merges.join(main, ["repo_name", "branch"]), folder=folder)
    found = with_identity(files.drop("internal_only"), touched, local_root(root))
    return found.join(dimension.select("repo_name", "internal_only"), "repo_name")


def ingest(
    spark: SparkSession,
    documents: DataFrame,
    table_path: str,
    embedder: Embedder,
    date_generated: str,
    strategies: Sequence[str] = (st.RECURSIVE_CHARACTER_TEXT_SPLITTING,),
    sizes: st.ChunkSizes = st.ChunkSizes(),
    on_mismatch: str = "error",
    rows_per_file: int = 0,
    compact: bool = False,
    buckets: int = ks.BUCKETS,
) -> int:
    """Chunk, embed and append ``documents``; rows the table already holds are left alone.

    The load is committed as a whole, and the number returned names the snapshot after it: searches
    over ``read_snapshot`` see each document's newest version with the access flag it has now. What
    a load reads of the stored keys and vectors are the buckets its own documents and texts fall
    into. Texts are shuffled once and written once, to the table; each distinct text without a stored
    vector goes to the model once. The vectors of a load that was stopped after its rows were written
    are kept for the next one.

    ``documents`` has ``document_id, document_name, document_version, repo_name, internal_only``
    and ``document_text``. A new table gets ``buckets`` buckets of keys and of vectors.
    """
    labels = [st.label(s, sizes) for s in strategies]
    table = vt.find_vector_table(spark, table_path)
    if table is not None:
        st.check_labels(labels, vt.stored_labels(spark, table_path), on_mismatch)
        if not ks.has_keys(spark, table_path):
            ks.index_table(table, table_path, 0, buckets)
    loads = table_log.find_loads(spark, table_path) or table_log.Loads(0)
    for stopped in table_log.without_vectors(spark, table_path):
        rows = vt.rows_of_load(spark, table_path, stopped)
        if not rows.isEmpty():
            ks.add_vectors(rows, table_path, buckets)
            table_log.keep_vectors(spark, table_path, stopped)
    load = table_log.begin(spark, table_path)
    scratch = shared_folder(spark, f"load-{load}")

    listed = _kept(documents.select(*table_log.STATE).distinct(), f"{scratch}/documents")
    chunks = chunk_documents(documents, list(strategies), sizes, embedder)
    keyed = chunks.withColumn("embedding_model", F.lit(embedder.name)).filter(~is_blank(F.col("chunk_content")))
    rows = keyed.select(*(c for c in vt.VECTOR_TABLE.fieldNames() if c not in ("embedding", "date_generated")))
    texts = _kept(rows.groupBy(*ks.TEXT_KEY).count(), f"{scratch}/texts")
    lacking = ks.without_vectors(spark, table_path, texts, buckets)
    missing = texts if lacking is None else _kept(lacking, f"{scratch}/missing")
    keys = ks.stored_keys(spark, table_path, listed, loads, buckets)
    with _joined_by_texts(spark):
        embedded = _with_vectors(rows, keys, texts, missing, table_path, embedder, buckets, f"{scratch}/often")
        dated = embedded.withColumn("date_generated", F.to_date(F.lit(date_generated)))
        vt.write_vector_table(dated, table_path, rows_per_file, compact=compact, load=load)
    new = vt.rows_of_load(spark, table_path, load)
    ks.add_vectors(new if lacking is None else ks.of_texts(new, missing), table_path, buckets)
    table_log.keep_vectors(spark, table_path, load)
    ks.add_keys(new, table_path, load, buckets)
    table_log.record(spark, table_path, load, listed)
    table_log.commit(spark, table_path, load)
    remove(spark, scratch)
    return load


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def _joined_by_texts(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by their texts are joined there by keys that hold more than the text."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _with_vectors(
    rows: DataFrame, keys: DataFrame | None, texts: DataFrame, missing: DataFrame, path: str, embedder: Embedder,
    buckets: int, scratch: str,
) -> DataFrame:
    """The rows that ``keys`` lacks, with vectors; their texts are shuffled once, by text.

    The rows of a text meet in one task, which takes its stored vector or sends it to the model.
    Texts of more than HOT_TEXT rows get their vectors first, so their rows need not meet.
    """
    spark, key = rows.sparkSession, list(ks.TEXT_KEY)
    often = texts.where(F.col("count") > HOT_TEXT).select(*key)
    if often.isEmpty():
        return _by_text(rows, keys, texts, path, embedder, buckets)
    hot = rows.join(F.broadcast(often), key, "left_semi")
    once = ks.of_texts(hot, missing.join(F.broadcast(often), key, "left_semi")).groupBy(*key).agg(F.any_value("chunk_content").alias("chunk_content"))
    made = _kept(once.withColumn("embedding", embed(F.col("chunk_content"), embedder)).drop("chunk_content"), scratch)
    known = ks.stored_vectors(spark, path, often, buckets)
    vectors = made if known is None else made.unionByName(known)
    found = (hot if keys is None else vt.only_new(hot, keys)).join(F.broadcast(vectors), key)
    rest = _by_text(rows.join(F.broadcast(often), key, "left_anti"), keys, texts, path, embedder, buckets)
    return rest.unionByName(found.select(*rest.columns))


def _by_text(
    rows: DataFrame, keys: DataFrame | None, texts: DataFrame, path: str, embedder: Embedder, buckets: int
) -> DataFrame:
    key = list(ks.TEXT_KEY)
    new = rows.repartition("chunk_id")
    if keys is not None:  # an anti join would be moved before the shuffle by text, and need one of its own
        stored = keys.repartition("chunk_id").distinct().withColumn("_stored", F.lit(True))
        new = new.join(stored, list(CHUNK_KEY), "left").where("_stored IS NULL").select(*rows.columns)
    vectors = ks.stored_vectors(rows.sparkSession, path, texts, buckets)
    nothing = F.lit(None).cast(VECTOR).alias("embedding")
    found = new.select("*", nothing) if vectors is None else new.join(vectors, key, "left").select(*new.columns, "embedding")
    return embed_once(found.sortWithinPartitions(*key), key, embedder)

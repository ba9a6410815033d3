"""Incremental loading: new files are ingested batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from passageworks.operators.embedding import Embedder
from passageworks.plans.ingest import ingest
from passageworks.sources.files import BINARY_FILE, extracted_documents, file_rows, name_pattern


def ingest_arriving_files(
    spark: SparkSession,
    root: str,
    table_path: str,
    checkpoint: str,
    embedder: Embedder,
    date_generated: str,
    identify: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
    **options,
) -> StreamingQuery:
    """Ingest the files below ``root`` that no earlier run has seen, then stop.

    ``identify`` adds id, repository and version to the documents of a batch. A batch repeated
    after a failure appends only rows that are not in the table yet.
    """
    arriving = (
        spark.readStream.schema(BINARY_FILE)
        .format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern())
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    documents = extracted_documents(file_rows(arriving))

    def load(batch: DataFrame, _: int) -> None:
        ingest(
            batch.sparkSession,
            identify(batch),
            table_path,
            embedder,
            date_generated,
            compact=True,
            **options,
        )

    return (
        documents.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

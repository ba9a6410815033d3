"""Chunking in Arrow batches holds few texts at once, however many a batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from passageworks.operators import chunking as ch
from passageworks.operators import strategies as st
from passageworks.operators.embedding import HashedWords
from passageworks.session import BATCH_BYTES


def test_texts_are_split_in_parts_of_bounded_size():
    texts = pa.array(["x" * 300_000, None, "", "y" * 3_000_000, *["z" * 100_000] * 40])
    parts = [p.to_pylist() for p in ch._text_slices(texts)]
    assert [t for p in parts for t in p] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= ch.BYTES_AT_ONCE for p in parts)
    assert len(parts) >= 6


def test_the_model_gets_a_bounded_number_of_sentences(spark, tmp_path):
    log = tmp_path / "sizes"

    class Counting(HashedWords):
        def encode(self, texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return super().encode(texts)

    docs = spark.range(300).coalesce(1).select(F.repeat(F.lit("One more. "), 50).alias("document_text"))
    ch.chunk_documents(docs, st.SEMANTIC_CHUNKING, embedder=Counting(16)).write.format("noop").mode("overwrite").save()
    sizes = [int(x) for x in log.read_text().split()]
    assert sum(sizes) >= 15_000 and max(sizes) <= ch.SENTENCES_AT_ONCE


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.createDataFrame([("a b",)], "document_text string")
    ch.chunk_documents(docs, st.RECURSIVE_CHARACTER_TEXT_SPLITTING).collect()
    assert int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES

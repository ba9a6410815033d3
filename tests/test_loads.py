"""Loads of a vector table: buckets they read, snapshots they leave, and loads that were stopped."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from passageworks.operators import strategies as st
from passageworks.operators.embedding import HashedWords, embed_question
from passageworks.operators.search import vector_search
from passageworks.plans import ingest as plan
from passageworks.plans.ingest import ingest
from passageworks.session import shared_folder
from passageworks.sources import folders, table_log
from passageworks.sources import key_store as ks
from passageworks.sources import vector_table as vt
from tests.test_rows import DOCS, MODEL, some_documents

DAY = "2024-01-01"


def load(spark, path, docs, model=MODEL, **how):
    return ingest(spark, docs, path, model, DAY, [st.BY_SENTENCE], **how)


def versions(table):
    return sorted({(r.document_id, r.document_version, r.internal_only) for r in table.collect()})


def test_a_load_reads_only_the_buckets_of_its_documents(spark):
    path = shared_folder(spark, "t")
    load(spark, path, some_documents(spark, 60), buckets=16)
    assert len(glob.glob(f"{path}/_keys/of-16/bucket=*")) == 16
    few = some_documents(spark, 2)
    keys = ks.stored_keys(spark, path, few, table_log.find_loads(spark, path))
    wanted = {r[0] for r in few.select(folders.bucket_of("document_id", 16)).collect()}
    stored = some_documents(spark, 60).select(folders.bucket_of("document_id", 16)).collect()
    assert keys.count() == 2 * sum(r[0] in wanted for r in stored)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", keys._jdf.queryExecution().executedPlan().toString())


def test_vectors_are_read_by_the_buckets_of_texts(spark):
    path = shared_folder(spark, "t")
    load(spark, path, some_documents(spark, 40), buckets=8)
    texts = vt.read_vector_table(spark, path).where("chunk_content = 'Shared end.'").select(*ks.TEXT_KEY).distinct()
    found = ks.stored_vectors(spark, path, texts)
    assert found.count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", found._jdf.queryExecution().executedPlan().toString())


def test_each_text_goes_to_the_model_once(spark, tmp_path):
    log = str(tmp_path / "seen")
    os.mkdir(log)

    class Counting(HashedWords):
        def encode(self, texts):
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts.to_pylist()))
            return super().encode(texts)

    def seen():
        return sorted(line for name in glob.glob(f"{log}/*") for line in open(name).read().split("\n"))

    path = shared_folder(spark, "t")
    load(spark, path, some_documents(spark, 30).repartition(6), Counting(16))
    assert seen() == sorted([f"Text number {i}." for i in range(30)] + ["Shared end."])
    load(spark, path, some_documents(spark, 31, "v2").repartition(6), Counting(16))
    assert seen() == sorted([f"Text number {i}." for i in range(31)] + ["Shared end."])
    assert vt.read_vector_table(spark, path).count() == 60 + 62


def test_snapshots_show_versions_and_flags_of_their_time(spark):
    path = shared_folder(spark, "t")
    first = load(spark, path, some_documents(spark, 3, "v1"))
    second = load(spark, path, some_documents(spark, 2, "v2").withColumn("internal_only", F.lit(True)))
    third = load(spark, path, some_documents(spark, 1, "v1"))  # back to the first state
    again = load(spark, path, some_documents(spark, 1, "v1"))
    assert (first, second, third, again) == (1, 2, 3, 4)
    v1 = [("id0", "v1", True), ("id1", "v1", False), ("id2", "v1", False)]
    v2 = [("id0", "v2", True), ("id1", "v2", True), ("id2", "v1", False)]
    assert versions(vt.read_snapshot(spark, path, first)) == v1
    assert versions(vt.read_snapshot(spark, path, second)) == v2
    assert versions(vt.read_snapshot(spark, path)) == [("id0", "v1", True), *v2[1:]]
    assert versions(vt.read_snapshot(spark, path, again)) == versions(vt.read_snapshot(spark, path, third))
    assert vt.read_vector_table(spark, path).count() == 10


def test_a_search_over_the_snapshot_finds_no_text_that_became_internal(spark):
    path = shared_folder(spark, "t")
    docs = some_documents(spark, 4).withColumn("internal_only", F.lit(False))
    load(spark, path, docs)
    load(spark, path, docs.where("document_id = 'id2'").withColumn("internal_only", F.lit(True)))
    question = embed_question("Text number 2.", MODEL)
    found = {r.document_name for r in vector_search(vt.read_snapshot(spark, path), question, k=20).collect()}
    assert found == {"d0.md", "d1.md", "d3.md"}
    everything = vector_search(vt.read_snapshot(spark, path), question, k=20, is_customer=False)
    assert {r.document_name for r in everything.collect()} == {"d0.md", "d1.md", "d2.md", "d3.md"}


@pytest.mark.parametrize("step", ["write_vector_table", "add_keys", "record", "commit"])
def test_a_stopped_load_is_not_seen_and_can_be_repeated(spark, monkeypatch, step):
    path = shared_folder(spark, "t")
    load(spark, path, some_documents(spark, 3, "v1"))
    where = {"write_vector_table": plan.vt, "add_keys": plan.ks}.get(step, plan.table_log)

    def stop(*a, **k):
        raise RuntimeError("stopped")

    monkeypatch.setattr(where, step, stop)
    with pytest.raises(RuntimeError, match="stopped"):
        load(spark, path, some_documents(spark, 5, "v2"))
    monkeypatch.undo()
    assert vt.read_vector_table(spark, path).count() == 6
    assert versions(vt.read_snapshot(spark, path)) == versions(vt.read_vector_table(spark, path))
    assert load(spark, path, some_documents(spark, 5, "v2")) == 3
    assert vt.read_vector_table(spark, path).count() == 16
    assert {v for _, v, _ in versions(vt.read_snapshot(spark, path))} == {"v2"}
    assert vt.read_snapshot(spark, path).count() == 10


def test_a_table_written_without_stores_is_indexed_first(spark):
    path = shared_folder(spark, "t")
    other = shared_folder(spark, "t")
    load(spark, other, some_documents(spark, 5))
    vt.write_vector_table(vt.read_vector_table(spark, other), path)
    assert vt.read_vector_table(spark, path).count() == 10
    load(spark, path, some_documents(spark, 6))
    assert vt.read_vector_table(spark, path).count() == 12


def test_empty_loads_and_documents_without_text_are_committed(spark):
    path = shared_folder(spark, "t")
    assert load(spark, path, spark.createDataFrame([], DOCS)) == 1
    rows = spark.createDataFrame([("i", "n", "v", "r", False, None), ("j", "n", "v", "r", False, "One. Two.")], DOCS)
    assert load(spark, path, rows) == 2
    assert {r.document_id for r in vt.read_snapshot(spark, path).collect()} == {"j"}

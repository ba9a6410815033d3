"""What a load moves: its texts go through one shuffle, whatever the table holds."""

import glob

import pytest
from pyspark.sql import functions as F

from passageworks.operators.embedding import HashedWords
from passageworks.plans import ingest as plan
from passageworks.session import shared_folder
from passageworks.sources import vector_table as vt
from tests.test_loads import load
from tests.test_rows import MODEL, some_documents


def test_texts_are_shuffled_once_by_a_load(spark, monkeypatch):
    path = shared_folder(spark, "t")
    load(spark, path, some_documents(spark, 30))
    plans, write = [], vt.write_vector_table

    def written(df, *a, **k):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        return write(df, *a, **k)

    monkeypatch.setattr(plan.vt, "write_vector_table", written)
    load(spark, path, some_documents(spark, 31, "v2"))
    # One shuffle each for the rows with their texts, the stored keys and the stored vectors.
    assert plans[0].count("Exchange hashpartitioning") == 3, plans[0]
    assert not glob.glob(f"{path}/../load-*/chunks*")


@pytest.mark.parametrize("stored", [False, True])
def test_texts_of_many_rows_do_not_meet_in_one_task(spark, tmp_path, monkeypatch, stored):
    log = tmp_path / "seen"
    log.write_text("")

    class Counting(HashedWords):
        def encode(self, texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts.to_pylist()))
            return super().encode(texts)

    monkeypatch.setattr(plan, "HOT_TEXT", 5)
    path = shared_folder(spark, "t")
    before = 2 if stored else 0
    if stored:
        load(spark, path, some_documents(spark, before), Counting(16))
    load(spark, path, some_documents(spark, 20, "v2").repartition(4), Counting(16))
    assert sorted(log.read_text().split("\n")[:-1]) == sorted([f"Text number {i}." for i in range(20)] + ["Shared end."])
    rows = vt.read_vector_table(spark, path)
    assert rows.count() == 2 * (20 + before)
    texts = rows.groupBy("chunk_content").agg(F.count_distinct("embedding").alias("n"))
    assert {r.n for r in texts.collect()} == {1}


def test_vectors_of_a_load_stopped_after_its_rows_are_kept(spark, tmp_path, monkeypatch):
    path = shared_folder(spark, "t")

    def stop(*a, **k):
        raise RuntimeError("stopped")

    monkeypatch.setattr(plan.ks, "add_vectors", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        load(spark, path, some_documents(spark, 5))
    monkeypatch.undo()

    class Refusing(HashedWords):
        def encode(self, texts):
            raise AssertionError("a text was sent again")

    assert load(spark, path, some_documents(spark, 5), Refusing(MODEL.dim)) == 2
    assert vt.read_vector_table(spark, path).count() == 10

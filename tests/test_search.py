import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageworks.functions.vectors import METRICS, metric
from passageworks.operators import search as se
from passageworks.operators.embedding import HashedWords, embed, embed_question

TABLE = "chunk_content string, document_name string, chunking_strategy string, embedding_model string, internal_only boolean, embedding array<float>"


def table(spark, n=600, hot=0.4, seed=1):
    """Vectors on a coarse grid, so that scores tie, with one row copied many times."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append(("hot", "copy.md", "s", "m", False, [1.0, 0.0, 1.0]))
        else:
            v = rng.integers(-1, 2, 3).astype(float).tolist()
            rows.append((f"c{i % 90}", f"d{i % 4}.md", "st"[i % 2], "m", i % 5 == 0, v))
    return spark.createDataFrame(rows, TABLE).repartition(6)


def score(name, a, b):
    a, b = np.array(a, float), np.array(b, float)
    if name == "inner_product":
        return a @ b
    if name == "manhattan_distance":
        return np.abs(a - b).sum()
    if name == "squared_euclidean_distance":
        return ((a - b) ** 2).sum()
    if name == "euclidean_distance":
        return np.sqrt(((a - b) ** 2).sum())
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    if not scale:
        return None
    return a @ b / scale if name == "cosine_similarity" else 1 - a @ b / scale


def brute(rows, question, name, k):
    found = set()
    for r in rows:
        s = score(name, r.embedding, question)
        found.add((None if s is None else round(float(s), 9) + 0.0, r.chunk_content, r.document_name))
    worst = float("inf")
    sign = -1 if METRICS[name] else 1
    ranked = sorted(found, key=lambda x: (worst if x[0] is None else sign * x[0], x[1], x[2]))
    return ranked[:k]


@pytest.mark.parametrize("name", sorted(METRICS))
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_single_search_is_exact(spark, name, k):
    t = table(spark)
    rows = [r for r in t.collect() if not r.internal_only and r.chunking_strategy == "s"]
    question = [0.3, -0.7, 1.1]
    got = [
        (r.score, r.chunk_content, r.document_name)
        for r in se.vector_search(t, question, k, name, strategy="s", model="m").collect()
    ]
    assert got == brute(rows, question, name, k)


@pytest.mark.parametrize("name", ["cosine_similarity", "euclidean_distance"])
def test_batch_search_agrees_with_brute_force(spark, name):
    t = table(spark)
    rows = t.collect()
    rng = np.random.default_rng(3)
    asked = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(25)]
    questions = spark.createDataFrame(asked, "qid long, embedding array<float>")
    want = sorted(
        (q, i + 1, *row)
        for q, v in asked
        for i, row in enumerate(brute(rows, v, name, 5))
    )
    for size in (1 << 20, 200):  # one block; several
        found = se.vector_search_batch(t, questions, 5, name, is_customer=False, bytes_per_block=size)
        got = sorted((r.qid, r.rank, r.score, r.chunk_content, r.document_name) for r in found.collect())
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], nan_ok=True)


def test_no_question_has_no_rows(spark):
    t = table(spark)
    for rows in ([], [(1, None)]):
        questions = spark.createDataFrame(rows, "qid long, embedding array<float>")
        assert se.vector_search_batch(t, questions).collect() == []


def test_customer_sees_no_internal_rows(spark):
    rows = [
        ("open", "a", "s", "m", False, [0.0, 1.0]),
        ("secret", "a", "s", "m", True, [1.0, 0.0]),
        ("other model", "a", "s", "x", False, [1.0, 0.0]),
    ]
    t = spark.createDataFrame(rows, TABLE)
    ask = lambda c: [r.chunk_content for r in se.vector_search(t, [1.0, 0.0], strategy="s", model="m", is_customer=c).collect()]
    assert ask(True) == ["open"]
    assert ask(False) == ["secret", "open"]


def test_vectors_of_different_length_are_refused(spark):
    t = spark.createDataFrame([("a", "a", "s", "m", False, [1.0, 2.0, 3.0])], TABLE)
    with pytest.raises(Exception, match="different length"):
        se.vector_search(t, [1.0, 0.0]).collect()
    with pytest.raises(Exception, match="different length"):
        t.select(metric("inner_product", F.col("embedding"), F.lit([1.0, 2.0]))).collect()


def test_zero_vector_has_no_cosine(spark):
    t = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert t.select(metric("cosine_similarity", F.col("a"), F.col("b"))).first()[0] is None
    assert t.select(metric("euclidean_distance", F.col("a"), F.col("b"))).first()[0] == 1.0


def test_unknown_metric_is_refused(spark):
    t = table(spark, n=3)
    with pytest.raises(ValueError):
        se.vector_search(t, [1.0, 0.0, 0.0], metric="dot")


def test_only_needed_columns_are_scanned_and_filters_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark).withColumn("extra", F.lit("x")).write.parquet(path)
    found = se.vector_search(spark.read.parquet(path), [1.0, 0.0, 0.0], strategy="s", model="m")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(chunking_strategy,s)" in text
    assert "extra" not in text


def test_batch_limits_ranks_before_the_shuffle(spark, small):
    t = table(spark)
    questions = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, embedding array<float>")
    text = se.vector_search_batch(t, questions)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_embedding_of_column_and_question_agree(spark):
    model = HashedWords(32)
    texts = ["Hello hello World", " leading and trailing ", "", None, "a\tb\nc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", embed(F.col("t"), model).alias("v")
    ).collect()
    for t, v in rows:
        assert v == (None if t is None else embed_question(t, model))
    assert embed_question("Hello hello World", model) == embed_question("world HELLO hello", model)
    assert model.encode(pa.array([""])).sum() == 0


def test_blocks_and_scans_change_nothing_and_questions_are_embedded_once(spark, small, tmp_path):
    import os
    import uuid

    from passageworks.operators.embedding import embed_questions
    from passageworks.queries import inputs as inp

    seen = str(tmp_path)

    class Counting(HashedWords):
        def encode(self, texts):
            with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(["x"] * len(texts)))
            return super().encode(texts)

    asked = inp.read(spark, small, "benchmark").selectExpr("item_id qid", "text question")
    table = inp.vector_table(spark, small)
    whole = se.vector_search_batch(table, embed_questions(asked, HashedWords(64))).collect()
    cut = se.vector_search_batch(
        table, embed_questions(asked, Counting(64)), bytes_per_block=2000, bytes_per_scan=6000
    ).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole)) and whole
    calls = [line for name in os.listdir(seen) for line in open(os.path.join(seen, name)).read().split()]
    assert len(calls) == asked.count()

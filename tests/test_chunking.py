import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageworks.operators import chunking as ch
from passageworks.operators import strategies as st
from passageworks.operators.embedding import HashedWords, in_slices


def chunks_of(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


FIVE = "Sentence 0. Sentence 1. Sentence 2. Sentence 3. Sentence 4."


def test_sliding_window_example(spark):
    assert chunks_of(spark, FIVE, lambda t: ch.sentence_windows(t, 3)) == [
        "Sentence 0. Sentence 1. Sentence 2.",
        "Sentence 1. Sentence 2. Sentence 3.",
        "Sentence 2. Sentence 3. Sentence 4.",
    ]


def test_short_texts_have_no_window(spark):
    assert chunks_of(spark, FIVE, lambda t: ch.sentence_windows(t, 6)) == []
    assert chunks_of(spark, FIVE, lambda t: ch.sentence_windows(t, 6, keep_short=True)) == [FIVE]
    assert chunks_of(spark, FIVE, lambda t: ch.sentence_windows(t, 5)) == [FIVE]


def test_paragraphs_keep_empty_ends(spark):
    assert chunks_of(spark, "a\n\n\nb\n\n", ch.paragraphs) == ["a", "b", ""]


def test_words_split_at_single_spaces(spark):
    text = "one  two\nthree "
    assert chunks_of(spark, text, lambda t: ch.every_n_words(t, 1)) == [
        "one", "", "two\nthree", "",
    ]
    assert chunks_of(spark, text, lambda t: ch.every_n_words(t, 100)) == ["one  two\nthree"]
    assert chunks_of(spark, "", lambda t: ch.every_n_words(t, 3)) == [""]


def test_character_windows(spark):
    text = "abcdefghij"
    assert chunks_of(spark, text, lambda t: ch.character_windows(t, 4, 1)) == [
        "abcd", "defg", "ghij",
    ]
    assert chunks_of(spark, "", lambda t: ch.character_windows(t, 4, 1)) == [""]


def pieces_and_merge(text, size, overlap, separators):
    """A plain list-based program for the same contract."""
    separator, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            separator, rest = s, separators[i + 1 :]
            break
    if separator:
        head, *tail = text.split(separator)
        pieces = [p for p in [head] + [separator + t for t in tail] if p]
    else:
        pieces = list(text)

    def merge(parts):
        out, window = [], []
        for part in parts:
            if window and len("".join(window)) + len(part) > size:
                out.append("".join(window).strip())
                while window and (
                    len("".join(window)) > overlap or len("".join(window)) + len(part) > size
                ):
                    window.pop(0)
            window.append(part)
        if window:
            out.append("".join(window).strip())
        return [x for x in out if x]

    result, short = [], []
    for piece in pieces:
        if len(piece) < size or not rest:
            short.append(piece)
            continue
        result += merge(short)
        short = []
        result += pieces_and_merge(piece, size, overlap, rest)
    return result + merge(short)


@pytest.mark.parametrize("seed", range(60))
def test_recursive_split_equals_plain_program(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["ab", "c", " ", "\n", "\n\n", "word", "x" * 37], k=rng.randint(0, 400)))
    size = rng.randint(2, 60)
    overlap = rng.randint(0, size - 1)
    got = ch.split_recursively(text, size, overlap)
    assert got == pieces_and_merge(text, size, overlap, list(ch.SEPARATORS)) if text else got == []
    assert all(len(c) <= size for c in got)
    if overlap == 0:
        assert "".join("".join(got).split()) == "".join(text.split())


def test_recursive_split_of_whole_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    made = documents.withColumn("c", ch.recursive_characters(F.col("text"), 300, 50))
    for row in made.collect():
        assert row.c == pieces_and_merge(row.text, 300, 50, list(ch.SEPARATORS))


def test_recursive_split_does_not_depend_on_partitions(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    column = ch.recursive_characters(F.col("text"), 120, 30)
    one = documents.coalesce(1).select("doc_id", column.alias("c"))
    many = documents.repartition(7).select("doc_id", column.alias("c"))
    assert sorted(one.collect()) == sorted(many.collect())


def test_semantic_by_brute_force(spark, small):
    model = HashedWords(64)
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    made = documents.select(
        "text", ch.sentences(F.col("text")).alias("s"), ch.semantic(F.col("text"), model).alias("c")
    )
    for row in made.collect():
        s = row.s
        groups = [" ".join(s[max(i - 1, 0) : i + 2]) for i in range(len(s))]
        v = [model.encode(pa.array([g]))[0] for g in groups]
        steps = [round(1 - float(a @ b), 6) for a, b in zip(v, v[1:])]
        bar = round(float(np.percentile(steps, 95)), 9) if steps else 0
        want, current = [], []
        for i, sentence in enumerate(s):
            current.append(sentence)
            if i < len(steps) and steps[i] > bar:
                want.append(" ".join(current))
                current = []
        want.append(" ".join(current))
        assert row.c == want


def test_slices_cover_the_batch():
    rows = pa.array([["a"] * n for n in (0, 5, 1, 9, 0, 2, 30, 1)])
    parts = list(in_slices(rows, limit=10))
    assert pa.concat_arrays([p for p in parts]).to_pylist() == rows.to_pylist()
    assert all(len(p) == 1 or sum(map(len, p.to_pylist())) <= 10 for p in parts)


def test_chunk_documents_in_one_pass(spark):
    documents = spark.createDataFrame(
        [("d1", "r", "A b c. D e f."), ("d2", "r", "")], "document_id string, repo_name string, document_text string"
    )
    made = ch.chunk_documents(
        documents, [st.BY_SENTENCE, st.EVERY_N_WORDS, st.BY_SENTENCE_WITH_SLIDING_WINDOW],
        st.ChunkSizes(words=2, sentences=2),
    )
    got = sorted((r.document_id, r.chunking_strategy, r.chunk_no, r.chunk_content) for r in made.collect())
    assert got == [
        ("d1", "By 2 sentences with a sliding window", 0, "A b c. D e f."),
        ("d1", "By sentence", 0, "A b c."),
        ("d1", "By sentence", 1, "D e f."),
        ("d1", "Every 2 words", 0, "A b"),
        ("d1", "Every 2 words", 1, "c. D"),
        ("d1", "Every 2 words", 2, "e f."),
        ("d2", "By sentence", 0, ""),
        ("d2", "Every 2 words", 0, ""),
    ]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_strategies_neither_shuffle_nor_leave_the_jvm(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", F.col("text").alias("document_text")
    )
    made = ch.chunk_documents(
        documents,
        [st.BY_PARAGRAPH, st.BY_SENTENCE, st.BY_SENTENCE_WITH_SLIDING_WINDOW, st.EVERY_N_WORDS],
    )
    text = plan(made)
    assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text


def test_each_text_is_split_in_python_once(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", F.col("text").alias("document_text")
    )
    text = plan(ch.chunk_documents(documents, st.RECURSIVE_CHARACTER_TEXT_SPLITTING))
    assert text.count("ArrowEvalPython") == 1


def test_labels_and_fallback():
    assert st.label(st.EVERY_N_WORDS) == "Every 100 words"
    assert (
        st.label(st.RECURSIVE_CHARACTER_TEXT_SPLITTING)
        == "Recursive character text splitting with chunk size = 300 and chunk overlap = 50"
    )
    assert st.resolve("by_Sentence") == st.BY_SENTENCE
    assert st.resolve("lines") == st.RECURSIVE_CHARACTER_TEXT_SPLITTING
    assert st.resolve(None) == st.RECURSIVE_CHARACTER_TEXT_SPLITTING
    with pytest.raises(ValueError):
        ch.chunk_column(F.lit("a"), "LINES")


def test_semantic_null_stays_null_in_any_batch(spark):
    rows = spark.createDataFrame([(0, None), (1, "One here. Two there. Three more."), (2, None)], "i int, t string")
    for parts in (1, 3):
        made = rows.repartitionByRange(parts, "i").select("i", ch.semantic(F.col("t"), HashedWords(64)).alias("c"))
        found = {r.i: r.c for r in made.collect()}
        assert found[0] is None and found[2] is None and found[1]

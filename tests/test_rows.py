"""Lineage, ordinals, conversations, sources, sinks and the two flows."""

import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from passageworks.operators import history as hi
from passageworks.operators import lineage as li
from passageworks.operators import strategies as st
from passageworks.operators.embedding import HashedWords, embed_chunks, embed_missing
from passageworks.operators.chunking import chunk_documents
from passageworks.operators.ordinal import assign_batches, number_rows
from passageworks.plans.answer import prompts
from passageworks.operators.stats import share_of_total
from passageworks.plans.ingest import Repo, ingest, read_corpus, with_identity
from passageworks.session import shared_folder
from passageworks.sources import vector_table as vt
from passageworks.sources.files import discover_files, read_documents
from passageworks.sources.history_files import read_history_files
from passageworks.sources.spread import spread
from passageworks.streaming.ingest import ingest_arriving_files

MODEL = HashedWords(16)


# ---------------------------------------------------------------- lineage


def test_name_status_lines(spark):
    diff = "M\ta.md\nD\tb.md\nR100\tc.md\td.md\nC75\te.md\tf.md\n\nX"
    df = spark.createDataFrame([("h", diff), ("g", "")], "commit_hash string, diff string")
    got = sorted(tuple(r) for r in li.parse_name_status(df).collect())
    assert got == [("h", "M", "a.md"), ("h", "R100", "d.md")]


def test_versions(spark):
    changes = spark.createDataFrame(
        [
            ("c1", 1, "main", "A", "a", "a"),
            ("c2", 2, "main", "M", "a", "a"),
            ("c3", 3, "main", "D", "a", "a"),
            ("c4", 4, "dev", "M", "a", "a"),
            ("c5", 5, "main", "R", "b", "c"),
        ],
        "commit_hash string, seq long, branch string, change_type string, old_path string, new_path string",
    )
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "filepath string")
    touched = li.touched_paths(changes, "main")
    got = {r.filepath: r.document_version for r in li.with_versions(files, touched).collect()}
    assert got == {"a": "c2", "b": None, "c": "c5"}
    ranked = {r.path: r.document_version for r in li.latest_versions_by_rank(touched).collect()}
    assert ranked == {"a": "c2", "c": "c5"}


# ---------------------------------------------------------------- ordinals


def test_numbers_of_a_hot_key_are_dense(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    numbered = number_rows(df, ["k"], ["i"], F.floor(F.col("i") / 64), "n", "total")
    seen = {}
    for k, i in rows:
        seen.setdefault(k, []).append(i)
    got = {(r.k, r.i): (r.n, r.total) for r in numbered.collect()}
    assert got == {
        (k, i): (n + 1, len(v)) for k, v in seen.items() for n, i in enumerate(sorted(v))
    }


@pytest.mark.parametrize("size,last", [(4, (3, 3)), (0, (1, 1)), (11, (1, 1)), (10, (1, 1))])
def test_batches(spark, size, last):
    df = spark.range(10).withColumn("k", F.lit("a"))
    got = assign_batches(df, size, ["k"], ["id"], F.floor(F.col("id") / 3)).orderBy("id").collect()
    assert (got[-1].batch_no, got[-1].total_batches) == last
    assert [r.batch_no for r in got] == sorted(r.batch_no for r in got)


# ---------------------------------------------------------------- conversations


def test_prefix_is_removed_everywhere_and_unknown_lines_dropped(spark):
    sep = "-" * 15
    text = f"{sep}\nUser: a User: b\n{sep}\nAI: c\n{sep}\nNote: d\n{sep}\n"
    df = spark.createDataFrame([(1, text)], "conv_id long, text string")
    got = [(r.role, r.text) for r in hi.parse_history(df).orderBy("part").collect()]
    assert got == [("user", "a b"), ("assistant", "c")]


def trimmed(turns, budget):
    """The plain program: whole messages from the end, then from the first user turn on."""
    system = [t for t in turns if t[2] == "system"]
    left = budget - sum(len(t[3].split()) for t in system)
    kept = []
    for t in sorted((t for t in turns if t[2] != "system"), key=lambda t: -t[1]):
        left -= len(t[3].split())
        if left < 0:
            break
        kept.insert(0, t)
    while kept and kept[0][2] != "user":
        kept.pop(0)
    return system + kept


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_trim_equals_plain_program(spark, block):
    rng = random.Random(block)
    talks = []
    for conv in range(30):
        length = 400 if conv == 0 else rng.randint(1, 12)  # one conversation holds most rows
        turns = []
        for turn in range(length):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant"])
            turns.append((conv, turn, role, " ".join(["w"] * rng.randint(0, 6))))
        talks.append(turns)
    df = spark.createDataFrame(
        [t for turns in talks for t in turns], "conv_id long, turn long, role string, text string"
    ).repartition(4)
    for budget in (0, 7, 20, 5000):
        got = sorted(tuple(r) for r in hi.trim_history(df, budget, turns_per_block=block).collect())
        assert got == sorted(t for turns in talks for t in trimmed(turns, budget))


def test_append_numbers_new_conversations_from_zero(spark):
    history = spark.createDataFrame([(1, 4, "user", "a")], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 1, "user", "b"), (2, 1, "user", "c")], "conv_id long, position int, role string, text string")
    got = sorted(tuple(r) for r in hi.append_turns(history, new).collect())
    assert got == [(1, 4, "user", "a"), (1, 5, "user", "b"), (2, 0, "user", "c")]


def test_history_files_keep_their_order_over_many_splits(spark, tmp_path):
    sep = "-" * 15
    for session in ("s1", "s2"):
        said = "".join(
            f"{sep}\n{'User: ' if i % 2 == 0 else 'AI: '}{session} message {i}\r\nnext\n" for i in range(500)
        )
        (tmp_path / f"chat_history_{session}.txt").write_bytes(said.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        messages = read_history_files(spark, str(tmp_path))
        got = messages.orderBy("conv_id", "turn").collect()
        assert messages.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [
        (s, i, "user" if i % 2 == 0 else "assistant", f"{s} message {i}\nnext")
        for s in ("s1", "s2")
        for i in range(500)
    ]


# ---------------------------------------------------------------- files


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
        )
    return out.getvalue()


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def corpus(root):
    (root / "repo" / "sub").mkdir(parents=True)
    (root / "repo" / "a.txt").write_bytes("one\r\ntwo\rthree é".encode())
    (root / "repo" / "sub" / "b.md").write_text("# Head\n\n- it's")
    (root / "repo" / "UPPER.MD").write_text("no")
    (root / "repo" / "x.py").write_text("no")
    (root / "repo" / "empty.txt").write_text("")
    (root / "repo" / "README.md").write_text("denied")
    table = (
        "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>"
        f"<w:tc>{paragraph('k')}{paragraph('l')}</w:tc><w:tc>{paragraph('v')}</w:tc></w:tr><w:tr>"
        f"<w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>{paragraph('wide')}</w:tc></w:tr></w:tbl>"
    )
    tabbed = "<w:p><w:r><w:t>c</w:t><w:tab/><w:t>d</w:t><w:br/></w:r></w:p>"
    (root / "repo" / "c.docx").write_bytes(docx(paragraph("first") + table + tabbed))


def test_discover_and_read(spark, tmp_path):
    corpus(tmp_path)
    root = str(tmp_path)
    names = sorted(r.document_name for r in discover_files(spark, root).collect())
    assert names == ["README.md", "a.txt", "b.md", "c.docx"]
    found = read_documents(spark, root, deny=["README.md"], internal_only=True, escape=True)
    got = {r.document_name: (r.filepath, r.internal_only, r.document_text) for r in found.collect()}
    base = f"{root}/repo"
    assert got == {
        "a.txt": (f"{base}/a.txt", True, "one\ntwo\nthree é"),
        "b.md": (f"{base}/sub/b.md", True, "Head\nit''s"),
        "c.docx": (
            f"{base}/c.docx", True, "first\n\nTable:\nk l,v\nwide,wide\n\n\nc\td\n\n\n",
        ),
    }


def test_malformed_text_stops_the_job_unless_tolerated(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\xfe end")
    with pytest.raises(Exception, match="MALFORMED"):
        read_documents(spark, str(tmp_path)).collect()
    (row,) = read_documents(spark, str(tmp_path), strict=False).collect()
    assert row.document_text.startswith("ok ") and row.document_text.endswith(" end")


def test_spread_only_widens_small_scans(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(12).write.parquet(str(tmp_path / "many"))
    assert spread(spark.read.parquet(str(tmp_path / "one")), "id").rdd.getNumPartitions() == 8
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        wide = spark.read.parquet(str(tmp_path / "many"))
        assert spread(wide, "id") is wide
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


# ---------------------------------------------------------------- sinks and flows

DOCS = "document_id string, document_name string, document_version string, repo_name string, internal_only boolean, document_text string"


def some_documents(spark, n=5, version="v"):
    rows = [(f"id{i}", f"d{i}.md", version, "r", i == 0, f"Text number {i}. Shared end.") for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_second_ingest_adds_nothing_and_new_rows_are_added(spark):
    path = shared_folder(spark, "t")
    run = lambda n, **o: ingest(spark, some_documents(spark, n), path, MODEL, "2024-01-01", [st.BY_SENTENCE], **o)
    run(5)
    first = vt.read_vector_table(spark, path)
    assert first.count() == 10
    assert vt.read_vector_table(spark, path).columns == vt.VECTOR_TABLE.fieldNames()
    run(5)
    assert vt.read_vector_table(spark, path).count() == 10
    run(7)
    rows = vt.read_vector_table(spark, path).collect()
    assert len(rows) == 14
    assert len({tuple(r.embedding) for r in rows if r.chunk_content == "Shared end."}) == 1


def test_new_versions_and_flags_are_stored_and_searched(spark):
    path = shared_folder(spark, "t")
    first = some_documents(spark, 3, "v1")
    second = some_documents(spark, 3, "v2").withColumn("internal_only", F.lit(True))
    for docs in (first, second, second):
        ingest(spark, docs, path, MODEL, "2024-01-01", [st.BY_SENTENCE])
    table = vt.read_vector_table(spark, path)
    assert table.count() == 12
    now = vt.current_versions(table, second)
    assert {(r.document_version, r.internal_only) for r in now.collect()} == {("v2", True)}
    assert now.count() == 6 and now.columns == table.columns


def test_labels_come_from_the_folders(spark):
    path = shared_folder(spark, "t")
    ingest(spark, some_documents(spark), path, MODEL, "2024-01-01", [st.RECURSIVE_CHARACTER_TEXT_SPLITTING])
    assert vt.stored_labels(spark, path) == {st.label(st.RECURSIVE_CHARACTER_TEXT_SPLITTING)}


def test_other_strategy_is_refused_or_allowed(spark):
    path = shared_folder(spark, "t")
    docs = some_documents(spark)
    ingest(spark, docs, path, MODEL, "2024-01-01", [st.BY_SENTENCE])
    with pytest.raises(st.StrategyMismatch):
        ingest(spark, docs, path, MODEL, "2024-01-01", [st.BY_PARAGRAPH])
    with pytest.warns(UserWarning):
        ingest(spark, docs, path, MODEL, "2024-01-01", [st.BY_PARAGRAPH], on_mismatch="warn")
    stored = {r[0] for r in st.stored_strategies(vt.read_vector_table(spark, path)).collect()}
    assert stored == {"By sentence", "By paragraph"}


def test_empty_table_has_no_mismatch(spark):
    requested = spark.createDataFrame([("By sentence",)], "chunking_strategy string")
    empty = spark.createDataFrame([], "chunking_strategy string")
    assert st.missing_strategies(requested, empty).collect() == []
    assert st.missing_strategies_except(requested, empty).collect() == []


def test_known_texts_do_not_reach_the_model(spark):
    class Refusing(HashedWords):
        def encode(self, texts):
            assert all(t.startswith("Text") for t in texts.to_pylist()), "known text embedded again"
            return super().encode(texts)

    chunks = chunk_documents(some_documents(spark), st.BY_SENTENCE)
    stored = embed_chunks(chunks.filter("chunk_content = 'Shared end.'"), MODEL, "2024-01-01")
    made = embed_missing(chunks, stored, Refusing(16), "2024-01-02")
    assert made.filter("embedding is not null").count() == 10


def test_null_in_a_row_stops_the_write(spark):
    docs = some_documents(spark, version=None)
    with pytest.raises(Exception, match="document_version must not be null"):
        ingest(spark, docs, shared_folder(spark, "t"), MODEL, "2024-01-01", [st.BY_SENTENCE])


def test_blank_chunks_are_not_stored_but_empty_ones_are(spark):
    docs = spark.createDataFrame([("i", "n", "v", "r", False, "a\n\n \n\nb\n\n")], DOCS)
    path = shared_folder(spark, "t")
    ingest(spark, docs, path, MODEL, "2024-01-01", [st.BY_PARAGRAPH])
    assert sorted(r.chunk_content for r in vt.read_vector_table(spark, path).collect()) == ["", "a", "b"]


def test_unknown_cache_format_is_refused(spark):
    with pytest.raises(ValueError):
        vt.save_embeddings(spark.range(1), "/tmp/none", "pickle")


def test_search_prunes_the_folders_of_the_table(spark):
    path = shared_folder(spark, "t")
    ingest(spark, some_documents(spark), path, MODEL, "2024-01-01", [st.BY_SENTENCE, st.EVERY_N_WORDS])
    table = vt.read_vector_table(spark, path).filter("chunking_strategy = 'By sentence'")
    text = table._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(chunking_strategy", text)


def test_arriving_files_are_ingested_once(spark, tmp_path):
    root, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    corpus(root)
    no_commits = spark.createDataFrame([], "commit_hash string, seq long, path string")

    def identify(docs):
        return with_identity(docs, no_commits, str(root)).fillna("v1", ["document_version"])

    def run():
        ingest_arriving_files(
            spark, str(root), table, checkpoint, MODEL, "2024-01-01", identify,
            files_per_batch=2, strategies=[st.BY_SENTENCE],
        ).awaitTermination()
        return sorted({r.document_name for r in vt.read_vector_table(spark, table).collect()})

    assert run() == ["README.md", "a.txt", "b.md", "c.docx"]
    rows = vt.read_vector_table(spark, table).count()
    (root / "repo" / "new.txt").write_text("New. File.")
    assert run() == ["README.md", "a.txt", "b.md", "c.docx", "new.txt"]
    assert vt.read_vector_table(spark, table).count() == rows + 2
    assert {r.repo_name for r in vt.read_vector_table(spark, table).collect()} == {"repo"}


def test_corpus_of_two_repositories(spark, tmp_path):
    corpus(tmp_path)
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "a.txt").write_text("Open text.")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.txt").write_text("Not listed.")
    changes = spark.createDataFrame(
        [
            ("repo", "c1", 1, "trunk", "A", "a.txt"),
            ("repo", "c2", 2, "main", "M", "a.txt"),
            ("repo", "c3", 3, "trunk", "M", "sub/b.md"),
            ("open", "c4", 1, "main", "A", "a.txt"),
        ],
        "repo_name string, commit_hash string, seq long, branch string, change_type string, new_path string",
    )
    repos = [Repo("repo", "trunk", internal_only=True), Repo("open")]
    found = read_corpus(spark, f"file://{tmp_path}/", repos, changes, deny=["README.md"])
    got = sorted(
        (r.repo_name, r.document_name, r.document_version, r.internal_only, r.document_id)
        for r in found.collect()
    )
    ident = lambda p: hashlib.sha256(f"{tmp_path}/{p}".encode()).hexdigest()
    assert got == [
        ("open", "a.txt", "c4", False, ident("open/a.txt")),
        ("repo", "a.txt", "c1", True, ident("repo/a.txt")),
        ("repo", "b.md", "c3", True, ident("repo/sub/b.md")),
        ("repo", "c.docx", None, True, ident("repo/c.docx")),
    ]


def test_merges_count_by_their_diff_to_the_first_parent(spark, tmp_path):
    corpus(tmp_path)
    changes = spark.createDataFrame(
        [("repo", "c1", 1, "main", "A", "a.txt"), ("repo", "c2", 2, "main", "M", "sub/b.md"), ("repo", "m3", 3, "main", "M", "sub/b.md")],
        "repo_name string, commit_hash string, seq long, branch string, change_type string, new_path string",
    )
    merges = spark.createDataFrame(
        [
            ("repo", "m3", 3, "main", "M\ta.txt\nD\tsub/b.md\nR090\told.md\tREADME.md\n"),
            ("repo", "m4", 4, "dev", "M\tsub/b.md"),
            ("other", "m5", 5, "main", "M\ta.txt"),
            ("repo", "m6", 6, "main", ""),
        ],
        "repo_name string, commit_hash string, seq long, branch string, diff string",
    )
    found = read_corpus(spark, str(tmp_path), [Repo("repo")], changes, merges=merges)
    got = {r.document_name: r.document_version for r in found.collect()}
    assert got == {"a.txt": "m3", "b.md": "c2", "README.md": "m3", "c.docx": None}


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i long")
    got = sorted((r.i, r.n) for r in number_rows(df, ["k"], ["i"], F.floor(F.col("i") / 2), "n").collect())
    assert got == [(1, 1), (2, 2), (3, 1)]
    shares = share_of_total(df, ["k", "i"], ["k"], F.col("i")).collect()
    assert sorted((r.i, r.share) for r in shares) == [(1, 33.333333), (2, 66.666667), (3, 100.0)]


def test_prompts(spark):
    path = shared_folder(spark, "t")
    ingest(spark, some_documents(spark), path, MODEL, "2024-01-01", [st.BY_SENTENCE])
    questions = spark.createDataFrame([(1, " Text number 3? "), (2, " \n")], "conv_id long, question string")
    history = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    (row,) = prompts(
        vt.read_vector_table(spark, path), questions, history, MODEL, "C: {context}|",
        strategy="By sentence", k=2,
    ).collect()
    assert row.conv_id == 1
    assert row.prompt.startswith("C: Text number")
    assert row.prompt.endswith("\n\n|\nsystem: Be kind.\nuser: hi\nassistant: hello\nuser: Text number 3?")


def test_unwanted_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.bin").write_bytes(b"x" * 5000)
    found = discover_files(spark, str(tmp_path)).select("document_name", "content")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert [r.document_name for r in found.collect()] == ["a.txt"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_no_text_is_shuffled_before_the_cut(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"words of turn {t}") for c in range(20) for t in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "m"))
    messages = spark.read.parquet(str(tmp_path / "m"))
    plan = hi.history_cuts(messages, 30)._jdf.queryExecution().optimizedPlan()
    shuffled = re.findall(r"Aggregate \[.*|Window \[.*|Join .*", plan.toString())
    assert shuffled and not any("text#" in line for line in shuffled)
    whole = hi.trim_history(messages, 30)
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert not re.search(r"Exchange hashpartitioning", text)


def test_trim_of_null_ids_zero_tokens_and_missing_turns(spark):
    rows = [
        (None, 0, "system", "a b"), (None, 1, "user", "one two three"), (None, 2, "assistant", ""), (None, 3, "user", "x y"),
        (7, 1, "user", ""), (7, 2, "assistant", "p q r s"), (7, 3, "user", None), (7, None, "user", "no turn"),
        (8, 1, "assistant", "only"), (9, 0, "system", "1 2 3 4 5 6 7"), (9, 1, "user", "late"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn) for r in hi.trim_history(messages, 4).collect()}
    assert got == {(None, 0), (None, 3), (7, 1), (7, 2), (7, 3), (9, 0)}

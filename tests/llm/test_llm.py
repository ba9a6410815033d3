"""The training-data operators against brute force, and on awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from passageworks.llm import (  # noqa: E402
    backoff_lm,
    cap_filters,
    jaccard_join,
    line_quality,
    p_stable,
    secret_scan,
    section_tokens,
    source_mix,
    toxicity,
)
from passageworks.llm import queries as q  # noqa: E402
from passageworks.llm import sentencepiece_codec as sp  # noqa: E402
from passageworks.llm.components import components  # noqa: E402

DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, count int, h string, "
    "units string, row string"
)
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs_of(spark, texts, sources=None):
    """Documents with further columns whose names the operators use themselves."""
    rows = [
        (i, t, None, (sources or {}).get(i, f"s{i % 3}"), None, 0.5, 1, "x", "u", "r")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " ", "\n", "a", "ä\u0000b", "The same text of six words", "The same text of six words", LONG, "x" * 70_000, "😀" * 50, "tab\tand line"]


# ---------------------------------------------------------------- 1


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.read(q.tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_file("piece_bpe_32k.model"))


def test_ids_equal_the_library(pieces, library):
    rng = random.Random(1)
    alphabet = "aabcd  \n\t▁é漢字😀́.,1<s>0xﬁ\u0000"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    words = "the of and thing ation tion unbelievable mmm ====== 1234567 ....".split()
    texts += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(30)) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 2000, "-" * 4001, " " * 500, *[t or "" for t in AWKWARD]]
    encoder = sp.Encoder(pieces)
    for text, ids in zip(texts, encoder(texts), strict=True):
        want = library.encode(text)
        assert ids.tolist() == want
        assert sp.decode(ids, pieces) == library.decode(want)


def test_decoding_any_ids_equals_the_library(pieces, library):
    rng = random.Random(2)
    for _ in range(800):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 12))]
        assert sp.decode(np.array(ids, dtype=int), pieces) == library.decode(ids)


def test_forgetting_units_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(sp, "MEMORY", 3)
    monkeypatch.setattr(sp, "MOST_SYMBOLS", 16)
    texts = ["one two three four five", "five six two one", None, "seven eight"]
    small = sp.Encoder(pieces)
    a = [small([t])[0].tolist() for t in texts]
    monkeypatch.undo()
    assert a == [ids.tolist() for ids in sp.Encoder(pieces)(texts)]


def test_op1_query(spark, small, library):
    rows = {r.doc_id: r for r in q.QUERIES["op1_sentencepiece"](spark, small).collect()}
    docs = q.table(spark, small, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoded_awkward(spark, pieces):
    out = sp.encoded(docs_of(spark, AWKWARD), pieces, sp.IDS_AND_TEXT, sp.ids_and_text).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == [t or "" for t in AWKWARD]
    assert out[0].ids == [2]
    assert sp.encoded(docs_of(spark, []), pieces, sp.DIGEST, sp.digest).count() == 0


# ---------------------------------------------------------------- 2


def brute_spans(text):
    rules = (
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    )
    out = []
    for k, (pattern, flags, right) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if right(m)]
    return [(s, e, secret_scan.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["token", "Api_Key", "apikey", "SECRET", "paſſword", "passwd", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789", "xyz-._", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s, e, k) for s, e, k, _ in secret_scan.base_spans(text)] == brute_spans(text)


def test_formats_are_inferred_and_found(spark):
    rng = random.Random(4)

    def key():
        return "sk-" + "".join(rng.choice("ABCDEFGHJKLMNP") for _ in range(6)) + "-" + "".join(rng.choice("23456789") for _ in range(8)) + "zz"

    texts = [f"here token = {key()} is set" for _ in range(60)]
    texts += [f"a bare one {key()} lies here" for _ in range(20)]
    texts += [f"see www.example{i}.org/some/long/path{i} and mail-{i}.host.example" for i in range(60)]
    rows = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts)).collect()}
    assert all(rows[i].n_assign == 1 and rows[i].n_format == 0 for i in range(60))
    assert sum(rows[i].n_format for i in range(60, 80)) >= 18
    assert sum(rows[i].n_format for i in range(80, 140)) == 0
    kept = secret_scan.without_secrets(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert kept[0].text == "here [secret] is set" and kept[0].units == "u"
    assert sum("[secret]" in r.text for r in kept[60:80]) >= 18
    assert [r.text for r in kept[80:]] == texts[80:]


def test_short_digitless_and_overlapping_formats(spark):
    rng = random.Random(6)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))

    def short():
        return "zk." + some("GHJKLMNPQ", 10)

    def long():
        return "K-" + some("GHJKLMNPQ", 6) + "-" + some("0123456789abcdef", 20) + "_" + some("GHJKLMNPQ", 6)

    words = ["internationalization and characteristic", "a well-established state-of-the-art misunderstanding", "see www.example.org/index"]
    for key in (short, long):
        texts = [f"here token = {key()} is set" for _ in range(60)] + [f"a bare one {key()} lies here" for _ in range(20)] + words * 8
        rows = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts)).collect()}
        assert all(rows[i].n_format == 0 for i in range(60))
        assert sum(rows[i].n_format for i in range(60, 80)) >= 18
        assert all(rows[i].n_format == 0 for i in range(80, len(texts)))
        kept = secret_scan.without_secrets(docs_of(spark, texts)).orderBy("doc_id").collect()
        assert sum(r.text == "a bare one [secret] lies here" for r in kept[60:80]) >= 18
        assert [r.text for r in kept[80:]] == texts[80:]


def test_a_rare_format_among_many_values_is_found_bare(spark):
    """60 of 20,060 labelled values have a format of their own: far fewer than one in a sample."""
    rng = random.Random(11)
    draw = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    texts = [f"x token = {draw('0123456789abcdef', 40)} y" for _ in range(20_000)]
    texts += [f"x token = {draw('GHJK', 4)}-{draw('0123456789', 6)}-{draw('QRST', 5)} y" for _ in range(60)]
    first = len(texts)
    bare = [f"{draw('GHJK', 4)}-{draw('0123456789', 6)}-{draw('QRST', 5)}" for _ in range(200)]
    texts += [f"a bare one {b} lies here" for b in bare]
    texts += [f"an order of 2024-12-{draw('0123456789', 4)} with notwithstanding words" for _ in range(50)]
    rows = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts)).collect()}
    found = [rows[first + i].spans == f"format:11:{11 + len(b)}" for i, b in enumerate(bare)]
    assert sum(found) >= 190
    assert all(rows[first + 200 + i].spans == "" for i in range(50))


def test_ordinary_classes_are_counted_over_all_text(spark):
    texts = ["ab 12 XY", None, "", "token = 0123456789abcdef zz", "ü-.é" + "q" * 100]
    found = secret_scan._found(docs_of(spark, texts), "text").collect()
    got = np.sum([r.classes for r in found], axis=0)
    want = Counter("".join(re.findall("[A-Za-z0-9+/_.=-]", "ab12XYzz-.q" + "q" * 99)).translate(secret_scan._CLASS))
    assert dict(zip(secret_scan.SYMBOLS, got.tolist(), strict=True)) == {s: want[s] for s in secret_scan.SYMBOLS}


def test_merging_generalises_to_a_loop():
    automaton = secret_scan.infer(["d" * n for n in range(12, 60)])
    assert len(automaton.stops) < 30
    assert automaton.score("d" * 70) > automaton.score("U" * 70)


def test_secrets_awkward(spark):
    out = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, AWKWARD)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == len(AWKWARD) and all(r.base_sha256 == empty and r.spans == "" for r in out.values())
    assert secret_scan.find_secrets(docs_of(spark, [])).count() == 0
    assert secret_scan.without_secrets(docs_of(spark, AWKWARD)).where("text IS NULL").count() == 1


def test_op2_query(spark, small):
    rows = {r.doc_id: r for r in q.QUERIES["op2_secret_scan"](spark, small).collect()}
    for d in q.table(spark, small, "documents").collect():
        want = brute_spans(d.text or "")
        got = rows[d.doc_id]
        assert got.base_sha256 == hashlib.sha256(secret_scan.spelled(want).encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == x for _, _, k in want) for x in secret_scan.KINDS)
        assert set(secret_scan.spelled(want).split(",")) <= set(got.spans.split(","))


# ---------------------------------------------------------------- 3


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double, bucket string")


def test_op3_query(spark, small):
    data = q.table(spark, small, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in data], dtype=np.float64)
    ids = np.array([r.vec_id for r in data])
    got = {}
    for r in q.QUERIES["op3_p_stable"](spark, small).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(d[np.flatnonzero(ids == m[1])[0]] - m[2]) < 1e-12 for m in mine)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits, total = hits + len(want & {m[1] for m in mine}), total + 10
    assert hits / total >= 0.9


def test_nearest_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0])]
    rows += [(i, [1.0, 0.0]) for i in (1, 2, 3)] + [(4, [0.0, 1.0]), (4, [0.0, 1.0]), (None, [1.0, 0.0])]
    table = vectors_of(spark, [(*r, 1, 0.0, "b") for r in rows])
    out = p_stable.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert out[3].score == math.sqrt(2)
    assert p_stable.nearest(vectors_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(p_stable, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(150, 4)) * 0.001 + 1, rng.normal(size=(50, 4))]
    table = vectors_of(spark, [(i, v.tolist(), 0, 0.0, "") for i, v in enumerate(x)])
    out = p_stable.nearest(table, F.col("vec_id") % 50 == 0, k=5).collect()
    f = np.array([np.float32(v) for v in x]).astype(np.float64)
    for i in range(0, 150, 50):
        d = np.sqrt(((f - f[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert sorted(r.vec_id for r in out if r.query_id == i) == sorted(np.argsort(d, kind="stable")[:5].tolist())


@pytest.mark.parametrize("probes", [1 << 16, 1])
def test_scattered_vectors_among_tight_groups(spark, monkeypatch, probes):
    """Most vectors are near copies, which says nothing about how far the others have to look."""
    monkeypatch.setattr(p_stable, "MOST_PROBES", probes)
    monkeypatch.setattr(p_stable, "QUERY_BLOCK", 8 * 32 * 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    for lo in range(0, 2600, 20):
        x[lo : lo + 20] = x[lo] + 1e-4 * rng.normal(size=(20, 32))
    f = x.astype(np.float32).astype(np.float64)
    table = vectors_of(spark, [(i, v.tolist(), 0, 0.0, "") for i, v in enumerate(f)])
    out = p_stable.nearest(table, F.col("vec_id") % 20 == 0, bucket=64).collect()
    hits = {True: [], False: []}
    for i in range(0, 4000, 20):
        d = np.sqrt(((f - f[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = {r.vec_id for r in out if r.query_id == i}
        assert len(mine) == 10
        hits[i >= 2600].append(len(mine & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(hits[False]) >= 0.95 and np.mean(hits[True]) >= 0.95


# ---------------------------------------------------------------- 4


def test_backoff_scores_equal_brute_force(spark, small):
    rows = q.table(spark, small, "documents").collect()
    words = {r.doc_id: r.text.encode().lower().split() for r in rows}
    got = {r.doc_id: r for r in q.QUERIES["op4_backoff_lm"](spark, small).collect()}
    one, two = Counter(), Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    everything = sum(one.values())
    assert len(got) == len(rows)
    for i, w in words.items():
        want = math.log(one[w[0]] / everything) + sum(math.log(two[a, b] / one[a]) for a, b in zip(w, w[1:]))
        assert got[i].n_words == len(w) and abs(got[i].score - want / len(w)) < 1e-8


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_on_other_documents(spark, order):
    corpus = ["a b c a b d", "b c a", "e"]
    texts = ["a b c", "c c b", "z a b d q", "", None]
    grams = Counter()
    for t in corpus:
        w = t.split()
        grams.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    everything = sum(c for g, c in grams.items() if len(g) == 1)

    def score(gram):
        if len(gram) == 1:
            return math.log(max(1, grams[gram]) / everything)
        if grams[gram]:
            return math.log(grams[gram] / grams[gram[:-1]])
        return math.log(0.4) + score(gram[1:])

    counts = backoff_lm.ngram_counts(docs_of(spark, corpus), order)
    out = backoff_lm.score_against(docs_of(spark, texts), counts, order).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        w = (t or "").split()
        assert r.n_words == len(w)
        if w:
            want = sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) / len(w)
            assert abs(r.score - want) < 1e-8
        else:
            assert r.score is None


def test_backoff_awkward(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "IN_BUCKET", 500)
    out = {r.doc_id: r for r in backoff_lm.backoff_scores(docs_of(spark, AWKWARD)).collect()}
    assert len(out) == len(AWKWARD)
    assert [out[i].score for i in range(4)] == [None] * 4
    assert out[8].n_words == 60_000 and out[6].score == out[7].score
    assert backoff_lm.backoff_scores(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_order_and_own_counts_left_out(spark, monkeypatch, order):
    monkeypatch.setattr(backoff_lm, "IN_BUCKET", 20)
    monkeypatch.setattr(backoff_lm, "IN_BLOCK", 40)
    texts = ["a b a b a b", "a b c a b d", "c", "", None, "q1 q2 q3 q4 q5 q6", "b c a b d d d"] + [f"the a b c of {i % 3} x" for i in range(9)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "a b a c"), (8, "the a b"), (None, "a b c a b"), (None, "c a b c")]
    # Null and repeated ids: one document each.
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")

    def grams(given):
        out = Counter()
        for w in given:
            out.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        return out

    of = {}
    for i, t in rows:
        of.setdefault(i, []).append((t or "").split())
    all_grams, all_words = grams([w for ws in of.values() for w in ws]), sum(len(w) for ws in of.values() for w in ws)

    def score(gram, counts, words):
        if len(gram) == 1:
            return math.log(max(1, counts[gram]) / max(1, words))
        if counts[gram]:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + score(gram[1:], counts, words)

    def mean(ws, counts, words):
        each = [score(tuple(w[max(0, i - order + 1) : i + 1]), counts, words) for w in ws for i in range(len(w))]
        return sum(each) / len(each) if each else None

    for share in (0.0005, 1e9):  # all that three documents have is common, or nothing is
        monkeypatch.setattr(backoff_lm, "COMMON", share)
        plain = {r.doc_id: r for r in backoff_lm.backoff_scores(frame, order).collect()}
        got = {r.doc_id: r for r in backoff_lm.document_scores(frame, order, order).collect()}
        assert got.keys() == plain.keys() == of.keys()
        for i, ws in of.items():
            n = sum(len(w) for w in ws)
            left = {g: c for g, c in (all_grams - grams(ws)).items()}
            for value, want in (
                (plain[i].score, mean(ws, all_grams, all_words)), (got[i].score, mean(ws, all_grams, all_words)),
                (got[i].left_out, mean(ws, Counter(left), all_words - n)),
            ):
                assert (value is None and want is None) or abs(value - want) < 1e-8
    # Words that no other document has are not the best of the corpus any more.
    assert min((r.left_out, r.doc_id) for r in got.values() if r.n_words > 4 and r.doc_id is not None)[1] == 5


# ---------------------------------------------------------------- 5


@pytest.fixture(scope="module")
def ranks():
    return section_tokens.read_ranks(q.tokenizer_file("byte_bpe_50k.tiktoken"))


def test_sections_sum_to_the_tokens(spark, ranks):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*AWKWARD[:8], *AWKWARD[10:], "one\n\n\n two\n   three\n", "\n\nä\n😀\n"]
    for rule in section_tokens.RULES:
        out = section_tokens.token_counts(docs_of(spark, texts), ranks, public_tokenizers.PATTERN, ("source", "text"), rule).collect()
        for i, t in enumerate(texts):
            whole = f"s{i % 3}\n{t or ''}"
            mine = sorted((r for r in out if r.doc_id == i), key=lambda r: (r.start, r.field != "source", r.section))
            assert sum(r.n_tokens for r in mine) == len(encoding.encode_ordinary(whole))
            assert len(mine) == 2 + (t or "").count("\n")
            assert mine[0].start == 0 and mine[-1].end == len(whole)
            assert all(a.end == b.start for a, b in zip(mine, mine[1:]))


def test_rules_for_crossing_tokens():
    start = np.array([0, 4, 5])
    ends = np.array([2, 6, 8])  # the second token has bytes 2 to 5: two, one and one in each section
    assert section_tokens.attribute(ends, start, "first")[0].tolist() == [0, 0, 2]
    assert section_tokens.attribute(ends, start, "last")[0].tolist() == [0, 2, 2]
    assert section_tokens.attribute(ends, start, "most")[0].tolist() == [0, 0, 2]
    assert section_tokens.attribute(np.array([3, 8]), np.array([0, 4, 5]), "most")[0].tolist() == [0, 2]
    assert section_tokens.attribute(ends, start, "most")[1].tolist() == [False, True, False]


# ---------------------------------------------------------------- 6 and 9


@pytest.mark.parametrize(("name", "label", "fold"), [("op6_line_quality", "quality", (5, 0)), ("op9_toxicity", "toxic", (4, 2))])
def test_held_out_accuracy(spark, name, label, fold):
    sf = "/root/testdata/sf0.01"
    out = q.QUERIES[name](spark, sf)
    assert out.count() == q.table(spark, sf, "documents").count()
    rows = out.join(q.table(spark, sf, "labels"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r[label] for r in held) / len(held)
    assert right >= 0.9


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], [(6, 1, 1)], [(5, 0, 0), (6, 1, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (99, 0, 1)]])
def test_classifiers_awkward(spark, rows):
    docs, labels = docs_of(spark, AWKWARD), labels_of(spark, rows)
    for module, label, apply in ((toxicity, "toxic", toxicity.toxicity), (line_quality, "quality", line_quality.quality)):
        model = module.train(docs, labels, F.lit(True), label)
        out = apply(docs, model).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
        assert apply(docs_of(spark, []), model).count() == 0
    kept = toxicity.keep_clean(docs, toxicity.train(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    row = np.array([0, 1, 1, 1, 2, 2])
    unary, links = rng.normal(size=6), rng.normal(size=(2, 2))
    got = line_quality.marginals(unary, row, links)
    pairs = np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        total, good, both = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for code in range(1 << len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            p = math.exp(sum(unary[a] * v for a, v in zip(at, y)) + sum(links[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += p
        assert np.allclose(got[at], good / total)
        pairs += both / total
    assert np.allclose(line_quality._pair_marginals(unary, row, links, got), pairs)


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 800)
    good = (rng.random(800) < np.where(y, 0.8, 0.1))[:, None]
    other = (rng.random(800) < np.where(y, 0.7, 0.1))[:, None]
    posterior, weight = toxicity.label_model(np.hstack([np.repeat(good, 4, axis=1), other]), y)
    assert weight[0] < 0.35 < weight[4]
    assert ((posterior > 0.5) == y).mean() > 0.85


# ---------------------------------------------------------------- 7


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    component = {i: i for i in sets}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    component[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("hot", [1, 16])
def test_join_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "HEAVY", 4 * hot)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 120))] for _ in range(12)]
    passage = [f"p{i}" for i in range(40)]
    texts = [*AWKWARD[:8], *AWKWARD[9:]]
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if rng.random() < 0.3:
            w += passage
        texts.append(" ".join(w).replace("w1", "W1") if rng.random() < 0.5 else " ".join(w))
    out = jaccard_join.similar_documents(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(texts)


def test_join_awkward(spark):
    assert jaccard_join.similar_documents(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["one two three four five six", None])
    twice = rows.union(rows).union(rows.withColumn("doc_id", F.lit(None).cast("long")))
    out = sorted(jaccard_join.similar_documents(twice).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in out][:4] == [(0, 2, 0), (0, 2, 0), (1, 0, 1), (1, 0, 1)]
    assert all(r.component_id is None for r in out[4:]) and len(out) == 6


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---------------------------------------------------------------- 8


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 64))
    x = np.concatenate([c + rng.normal(size=(n, 64)) * s for c, n, s in zip(centre, [60, 40, 5, 5, 2, 2, 1, 1, 1, 9, 9, 9], [0.02, 0.2, 0.25, 0.3] * 3)])
    x = x.astype(np.float32)
    label = [None if i % 17 == 0 else i % 2 for i in range(len(x))]
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    same = np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(close, False)
    close &= same
    out = cap_filters.near_vectors(
        vectors_of(spark, [(i, v.tolist(), label[i], 0.0, "") for i, v in enumerate(x)]), block=16
    ).orderBy("vec_id").collect()
    n = np.array([r.n_links for r in out])
    assert (n <= close.sum(axis=1)).all() and n.sum() >= 0.97 * close.sum()
    least = np.arange(len(x))
    for _ in range(len(x)):
        least = np.minimum(least, np.where(close, least[None, :], len(x)).min(axis=1))
    assert sum(r.component_id == c for r, c in zip(out, least)) >= 0.97 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_near_vectors_awkward(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    out = cap_filters.near_vectors(vectors_of(spark, [(*r, 0.0, "") for r in rows])).collect()
    assert len(out) == len(rows)
    assert {r.vec_id: (r.component_id, r.kept) for r in out if r.vec_id} == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True)}
    assert cap_filters.near_vectors(vectors_of(spark, [])).count() == 0


def test_filters_grow_with_a_label_and_keep_their_recall():
    assert [cap_filters.words_for(n) for n in (0, 10_000, 40_000, 1_000_000)] == [100, 100, 100, 500]
    assert cap_filters.words_for(10**7) ** 2 >= 10**7 * cap_filters.BEST / cap_filters.IN_CELL
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(2, 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for words in (100, 400, 1000):
        best = cap_filters.best_for(words)
        a, b = cap_filters.code_words(64, words)
        cap = cap_filters.cap_height(64, words, best / 2)
        found = [set(zip(*(c.tolist() for c in cap_filters.list_decode(v, a, b, cap, best)))) for v in (x, y)]
        assert len({row for row, _ in found[0] & found[1]}) >= 0.99 * len(x)
        assert len(found[0]) <= 2 * best * len(x)


def test_list_decoding_finds_all_filters():
    a, b = cap_filters.code_words(16, 20)
    x = np.random.default_rng(1).normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, found = cap_filters.list_decode(x, a, b, 0.5, best=3)
    every = ((x[:, :8] @ a.T)[:, :, None] + (x[:, 8:] @ b.T)[:, None, :]).reshape(50, -1) / math.sqrt(2)
    for i in range(50):
        want = set(np.flatnonzero(every[i] >= 0.5)) | set(np.argsort(-every[i])[:3])
        assert set(found[row == i]) == want


# ---------------------------------------------------------------- 10


def test_targets_and_takings(spark, small):
    out = q.QUERIES["op10_source_mix"](spark, small)
    docs = q.table(spark, small, "documents")
    assert out.count() == docs.count()
    again = q.QUERIES["op10_source_mix"](spark, small)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = out.collect()
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")) for r in rows)
    names = sorted(set(source.values()))
    size = {s: sum(r.size for r in rows if source[r.doc_id] == s) for s in names}
    taken = {s: sum(r.taken for r in rows if source[r.doc_id] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = brute_targets(size, weight)
    longest = {s: max(r.size for r in rows if source[r.doc_id] == s) for s in names}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)


def brute_targets(size, weight):
    full = {}
    while True:
        rest = sum(size.values()) - sum(full.values())
        open_ = sum(w for s, w in weight.items() if s not in full)
        target = {s: full[s] if s in full else rest * w / open_ for s, w in weight.items()}
        over = [s for s in target if s not in full and target[s] > 3 * size[s]]
        if not over:
            return target
        full |= {s: 3 * size[s] for s in over}


def test_mix_awkward(spark):
    sources = {0: None, 1: None, 2: "z", 8: "a", 9: "a"}
    docs = docs_of(spark, AWKWARD, sources)
    docs = docs.union(docs.where("doc_id = 6"))
    plan = source_mix.plan_mix(docs)
    out = source_mix.taken_words(docs, plan).collect()
    assert len(out) == len(AWKWARD) + 1
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9 for r in out)
    mix = source_mix.mixed(docs, plan)
    assert mix.columns == [*docs.columns, "shard"]
    assert sum(len(r.shards.split(",")) for r in out if r.shards) == mix.count()
    assert mix.agg(F.sum(source_mix.words(F.col("text")))).first()[0] == sum(r.taken for r in out)
    empty = docs_of(spark, [])
    assert source_mix.taken_words(empty, source_mix.plan_mix(empty)).count() == 0
    assert source_mix.mixed(empty, source_mix.plan_mix(empty)).count() == 0


@pytest.mark.parametrize("copies,others", [(2000, 0), (2000, 500), (3, 1)])
def test_targets_end_among_copies(spark, copies, others):
    """A source that is mostly copies of one row takes its target to within a row."""
    rows = [(7, "a b c d e f g h i j", "a", 0)] * copies
    rows += [(100 + i, " ".join("x" * (i % 30)), "a", 0) for i in range(others)]
    rows += [(10_000 + i, "w " * 25, "b", 0) for i in range(600)] + [(20_000 + i, "w " * 20, None, 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard int").repartition(6)
    plan = source_mix.plan_mix(docs)
    out = source_mix.taken_words(docs, plan).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[2] for r in rows}
    for name in ("a", "b", None):
        mine = [r for r in out if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
    again = source_mix.taken_words(docs, source_mix.plan_mix(docs)).collect()
    columns = ("doc_id", "taken", "target")
    assert sorted(tuple(r[c] for c in columns) for r in out) == sorted(tuple(r[c] for c in columns) for r in again)
    mix = source_mix.mixed(docs, plan)
    assert mix.columns == [*docs.columns, "_shard"]
    per_shard = Counter(s for r in out for s in r.shards.split(",") if s)
    assert {str(r["_shard"]): r["count"] for r in mix.groupBy("_shard").count().collect()} == dict(per_shard)


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    names = [f"s{i:05d}" for i in range(20_000)] + [None]
    size = {n: int(rng.paretovariate(0.8)) for n in names}
    sizes = spark.createDataFrame([(n, size[n], 1) for n in names], "source string, source_size bigint, n_docs bigint").repartition(8)
    got = {r.source: r for r in source_mix.source_targets(sizes, source_mix.WEIGHTS).collect()}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want = brute_targets(size, weight)
    assert sorted(r.i for r in got.values()) == list(range(len(names)))
    assert all(abs(got[n].target - want[n]) <= 1e-6 * max(1, want[n]) for n in names)


def test_quotas_are_split_exactly(spark):
    quotas = [1000, 37, 0, 4, 5000]
    rows = source_mix.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 13, 3).orderBy("shard").collect()
    parts = np.array([r.quotas for r in rows])
    assert [r.shard for r in rows] == list(range(13))
    assert parts.min() >= 0 and parts.sum(axis=0).tolist() == quotas
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 4


def test_hypergeometric_draws_have_the_right_moments(spark):
    total, marked, drawn = 500, 120, 200
    x = source_mix._hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.col("u"))
    got = np.array([r[0] for r in spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u")).select(x).collect()])
    mean = drawn * marked / total
    variance = mean * (1 - marked / total) * (total - drawn) / (total - 1)
    assert abs(got.mean() - mean) < 0.05 and abs(got.var() / variance - 1) < 0.02


def test_no_python_in_the_mix(spark, small):
    docs = q.table(spark, small, "documents")
    plan = source_mix.mixed(docs, source_mix.plan_mix(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_one_by_one(spark, small):
    import corpus_pipeline as cp

    docs = q.table(spark, small, "documents")
    step = dict(cp.STAGES)
    columns = docs.columns

    def run(name, given):
        return cp.written(step[name](spark, given, small), f"test-{name}")

    clean = run("toxicity", docs)
    scores = {r.doc_id: r.predicted for r in q.QUERIES["op9_toxicity"](spark, small).collect()}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}
    single = run("ngram_jaccard_join", clean)
    texts = {r.doc_id: r.text for r in clean.collect()}
    ids = sorted(texts)
    brute = brute_components([texts[i] for i in ids])
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == [ids[i] for i in brute if brute[i][1] == i]
    masked = run("secret_scan", single)
    assert masked.columns == columns and masked.count() == single.count()
    assert not any(brute_spans(r.text) for r in masked.collect())
    mixed = run("source_mix", masked)
    taken = {r.doc_id: r.taken // r.size for r in source_mix.taken_words(masked, source_mix.plan_mix(masked)).collect() if r.size}
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})
    last = run("sentencepiece", mixed)
    assert last.count() == mixed.count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "source_mix", "sentencepiece"]


def test_pipeline_stages_on_awkward_rows(spark, small):
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for texts in (AWKWARD, []):
        docs = docs_of(spark, texts).select(columns)
        docs = docs.union(docs)
        for _, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, small), "awkward")
        assert (docs.count() > 0) == bool(texts)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))

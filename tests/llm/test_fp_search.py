"""Ranked search against a plain scoring of every document, and the bounds of the trie."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from passageworks.llm import fp_search as fs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, terms_of(t)) for i, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        rows = []
        for i, b in bags:
            tf, score = Counter(b), 0
            for t in set(terms_of(text)):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 50 + 50 * len(b) * n // total
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 0.5, "x") for i, t in docs], "doc_id bigint, text string, rank int, score double, head string")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, rank int")
    return d, i


def agrees(spark, docs, items, k=5, **how):
    got = fs.ranked_documents(*tables(spark, docs, items), k=k, **how).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, k)


def made(rng, n, words=60):
    pool = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(pool, weights, k=rng.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("bucket", [1, 8, 64])
def test_agrees_with_plain_scoring(spark, bucket):
    rng = random.Random(bucket)
    docs = made(rng, 400)
    items = [(j, " ".join(rng.sample([f"W{i}" for i in range(70)], 12))) for j in range(15)]
    agrees(spark, docs, items, bucket=bucket)


def test_several_tries_in_a_task_and_blocks_of_items(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(fs, "POSTINGS", 300)
    docs, items = made(rng, 300), [(j, f"w{j} w{j + 1} w{3 * j}") for j in range(12)]
    agrees(spark, docs, items, bytes_per_block=100)


def test_awkward_texts(spark):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    docs = [
        (1, None), (2, ""), (3, " \n"), (4, "Ärger ärger ÄRGER"), (5, "a\u0000b a_b a{b 日本 語"), (6, long), (7, "x" * 70_000),
        (8, "the same text"), (8, "the same text"), (9, "The Same TEXT"), (None, "the same text"), (None, None), (-5, "the same text"),
        (10, "😀😀 the"), (11, "\x7f\x80é the"),
    ]
    items = [(1, "the same"), (1, "the same"), (2, None), (3, ""), (4, "ärger ÄRGER a b 日本"), (None, "text t5 t976"), (7, "x" * 70_000), (8, "nowhere"), (9, "😀😀 \x80é")]
    for k in (2, 50):
        agrees(spark, docs, items, k=k)


def test_large_groups_of_copies_keep_ties_by_id(spark):
    docs = [(i, "one two three four") for i in range(3000, 0, -1)] + [(5000 + i, f"one two {i}") for i in range(200)]
    agrees(spark, docs, [(1, "two three"), (2, "one"), (3, "one 17 18")], k=50)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert fs.ranked_documents(*tables(spark, [], items)).collect() == []
    assert fs.ranked_documents(*tables(spark, docs, [])).collect() == []
    assert fs.ranked_documents(*tables(spark, [(1, None)], items)).collect() == []


def trie_of(seed, n=3000, bucket=16):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 30, n)
    rows = [np.unique((200 * rng.random(s) ** 3).astype(np.int64)) for s in sizes]
    sizes = np.array([len(r) for r in rows])
    term = np.concatenate(rows)
    tf = rng.integers(1, 6, len(term))
    return fs.build(np.arange(n), rng.integers(50, 300, n), np.r_[0, np.cumsum(sizes)], term, tf, bucket), rng


def test_bounds_hold_for_every_node_and_buckets_are_left_out():
    trie, rng = trie_of(1)
    buckets = np.flatnonzero(trie.children == 0)
    assert sorted(zip(trie.lo[buckets], trie.hi[buckets], strict=True))[0][0] == 0
    assert (trie.hi - trie.lo)[buckets].sum() == len(trie.doc)
    visited = 0
    for _ in range(10):
        terms = np.sort(rng.choice(200, 6, replace=False))
        weights = rng.integers(1, 8000, 6)
        dense = np.zeros(200, dtype=np.int64)
        dense[terms] = weights
        scores = np.add.reduceat(dense[trie.term] * trie.impact, trie.begin[:-1])
        bounds = trie.bounds(np.arange(len(trie.lo)), terms, weights)
        for lo, hi, bound in zip(trie.lo, trie.hi, bounds, strict=True):
            assert scores[lo:hi].max() <= bound
        best = fs.Best(10)
        visited += fs.search(trie, terms, weights, best, dense)
        order = np.lexsort((trie.doc, -scores))
        order = order[scores[order] > 0][:10]
        assert best.score.tolist() == scores[order].tolist() and best.doc.tolist() == trie.doc[order].tolist()
    assert visited < 0.7 * 10 * len(buckets)


def test_paths_are_shared():
    """Documents below a node begin with the same terms, and siblings part at the next one."""
    trie, _ = trie_of(2)
    for node in np.flatnonzero(trie.children > 0):
        below = range(trie.child[node], trie.child[node] + trie.children[node])
        assert [trie.lo[b] for b in below][1:] == [trie.hi[b] for b in below][:-1]
        assert trie.lo[below[0]] == trie.lo[node] and trie.hi[below[-1]] == trie.hi[node]


def test_terms_of_a_long_text_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(fs, "CHUNK", 10)
    text = "Aa bb-cc " * 50 + "d" * 100 + " é"
    assert [t.decode() for part in fs.terms_of(text.encode()) for t in part] == terms_of(text)

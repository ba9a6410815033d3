"""Hard negatives against a comparison of all rows, the curve, and the bounds of zone maps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.llm import hilbert_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, block bigint, q string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 0.5) for i, v, y in rows], SCHEMA)


def brute(rows, every, positives, k, window):
    good = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        good[i] = min(good.get(i, row), row)
    out = []
    for a, (ya, va) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, y) for i, (y, v) in good.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == ya][:positives]:
            fits = [s for s in scored if s[2] != ya and window[0] * -ps <= 100 * -s[0] <= window[1] * -ps][:k]
            out += [(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def agrees(spark, rows, every=10, positives=5, k=10, window=(30, 90), **how):
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, positives, k, window, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, every, positives, k, window)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def clustered(rng, n, dim=8, groups=6, labels=3):
    centre = rng.normal(size=(groups, dim))
    kind = rng.integers(0, groups, n)
    x = centre[kind] + 0.15 * rng.normal(size=(n, dim))
    return [(int(i), [float(v) for v in r], int(y)) for i, r, y in zip(rng.permutation(n), x, rng.integers(0, labels, n), strict=True)]


@pytest.mark.parametrize("seed,rows_per_block", [(1, 16), (2, 64), (3, 1024)])
def test_agrees_with_comparing_all(spark, seed, rows_per_block):
    assert agrees(spark, clustered(np.random.default_rng(seed), 500), rows_per_block=rows_per_block)


def test_ties_copies_and_small_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 3)], int(rng.integers(0, 2))) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0], i % 2) for i in range(400)]
    assert agrees(spark, rows, every=25, rows_per_block=32)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.1], 2), (2, [0.4, 0.1], 2), (2, [0.5, 0.1], 2), (3, None, 1), (4, [None, 1.0], 1),
        (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [0.0, 0.0], 2), (8, [0.6, 0.2], None), (None, [0.6, 0.2], 2),
        (10, [-1.0, -1.0], 1), (20, [0.3, 0.3], 9), (9, [0.7, 0.1], 3), (-10, [0.8, 0.3], 1),
    ]
    assert agrees(spark, rows)
    assert agrees(spark, rows[:1]) == []
    assert agrees(spark, []) == []
    assert agrees(spark, [(1, None, 1), (10, [0.1, 0.2], None)]) == []
    assert agrees(spark, [(1, [0.1], 1), (2, [0.2], 2)]) == []  # no anchors


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 100_000], i % 3) for i in range(120)]
    assert agrees(spark, rows)  # integers above the 2^53 of doubles
    with pytest.raises(ValueError, match="2\\^56"):
        hn.hard_negatives(table(spark, [(1, [1e30], 1)]), F.col("vec_id") == 1)


def test_vectors_of_different_length_are_refused(spark):
    with pytest.raises(ValueError, match="different length"):
        hn.hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]), F.col("vec_id") == 1)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (8, 1), (1, 5)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    key = hn.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_interval_holds_every_product():
    rng = np.random.default_rng(7)
    x, rows = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (5, 30, 6))
    least, most = hn.interval(x, rows.min(axis=1), rows.max(axis=1))
    products = np.einsum("ad,brd->abr", x, rows)
    assert (products.min(axis=2) >= least).all() and (products.max(axis=2) <= most).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """On grouped vectors, tiles of few anchors read a part of the blocks only."""
    rng = np.random.default_rng(8)
    rows = clustered(rng, 3000, dim=6, groups=12, labels=2)
    seen = []
    choose = hn.blocks_to_read
    tiles, shelves = hn._tiles, hn._shelves

    def counted(shelves, tiles, groups, *rest):
        reads = choose(shelves, tiles, groups, *rest)
        every = tiles.count() * shelves.agg(F.sum(F.size("blocks"))).first()[0]
        seen.append(reads.count() / every)
        return reads

    monkeypatch.setattr(hn, "blocks_to_read", counted)
    monkeypatch.setattr(hn, "_tiles", lambda b, d, s: tiles(b, d, s, 4))
    monkeypatch.setattr(hn, "_shelves", lambda b: shelves(b, 4))
    assert agrees(spark, rows, every=50, rows_per_block=50)
    assert seen[0] < 0.5 and len(seen) == 2

"""What op4 moves: no texts, and whole hashes only of n-grams that other blocks may have."""

import numpy as np
import pyarrow as pa

from passageworks.llm import backoff_lm


def test_texts_stay_where_they_are(spark):
    frame = spark.createDataFrame([(i, f"a b c {i} d e f") for i in range(20)], "doc_id bigint, text string")
    plan = backoff_lm.document_scores(frame)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "texts" in line]
    assert len(scans) == 2 and all("Bucketed: true" in plan[i] for i in scans)
    for i in scans:
        above, at = [], depth[i]
        for line, d in zip(reversed(plan[:i]), reversed(depth[:i])):
            if d < at:
                above.append(line)
                at = d
        # The first step above a scan that is no sort or projection takes the texts in.
        taken = next(line for line in above if "Sort [" not in line and "Project [" not in line)
        assert "FlatMapCoGroupsInArrow" in taken, plan


def test_ngrams_of_one_block_are_not_sent():
    word = [f"w{i}" for i in range(3000)]
    texts = pa.array([" ".join(word[i : i + 30]) for i in range(0, 3000, 30)], pa.large_string())
    none, ids = np.zeros(0, np.uint64), pa.array(range(len(texts)))
    block = backoff_lm._Block(ids, pa.array([False] * len(texts)), texts, none, 3, 1)
    pairs, prints, new = block.prints(40)
    assert len(block.distinct) == 3000 + 2900 + 2800 and len(pairs) == 2900
    assert (prints[new] == backoff_lm._pairs(texts, none, 3, 40)).all()
    assert len(block.asked(pairs, np.zeros(2900, bool))) == 3000  # its words alone
    assert len(block.asked(pairs, np.ones(2900, bool))) == len(block.distinct)
    # Fingerprints cost a part of what hashes cost, and hashes less than their eight bytes.
    assert len(backoff_lm._packed_steps(prints[new])) < 4.5 * 2900
    assert len(backoff_lm._packed_steps(block.distinct)) < 7.2 * len(block.distinct)


def test_packed_numbers_come_back():
    for values in ([], [5], [1, 1, 2, 70_000, 1 << 62], [-(1 << 62), 3, -1]):
        values = np.array(values, np.int64)
        assert (backoff_lm._numbers(backoff_lm._packed_numbers(values)) == values).all()
        assert (backoff_lm._steps(backoff_lm._packed_steps(values)) == values).all()
    high = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (backoff_lm._steps(backoff_lm._packed_steps(high)).view(np.uint64) == high).all()

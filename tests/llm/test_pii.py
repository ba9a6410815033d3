"""Personal data: base spans against plain regular expressions, added spans on planted formats."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from passageworks.llm import matches
from passageworks.llm import pii_boosting as pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def base_of(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in KINDS.items()
        for m in re.finditer(pattern, text or "")
        if holds(kind, m[0])
    ]


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d))


def docs_of(spark, texts):
    rows = [(i, t, "a", 0.5, 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string, score double, rid int, regions string")


def found(spark, texts):
    rows = pii.find_personal_data(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: r for r in rows}


def agrees(row, text):
    base = base_of(text)
    spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
    assert row["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest(), (text or "")[:200]
    assert [row[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
    spans = row["spans"].split(",") if row["spans"] else []
    assert set(spelled.split(",")) - {""} <= set(spans)
    assert len(spans) == len(base) + row["n_likely"]


AWKWARD = [
    None, "", " ", "@", "a@", "a@b", "a@b.c", "a@b.c@d.e", "a@b.c_d@e.f", "ä.b@c-d.ef.gh.", "x@y..z", "😀1.2.3.4😀 5.6.7.8",
    "1.2.3.4.5.6.7.8", "0001.002.3.0255", "256.1.1.1", "1.2.3", "1.2.3.4" * 300, "+1 (377) 555-0271", "+12", "+1-", "++1 22-333 4444 5",
    "+1 " + "(" * 5000 + "2345678901", "+1 (171) 555-2028 4736962573099581", "4" * 100_000, "4736962573099581 4736962573099581",
    "4111 1111 1111 1111", "4111-1111-1111-1111 2", "a" * 9_000, "a" * 9_000 + "@b.cd", "1 " * 40_000, "x@y.zz " * 3000,
    "((((((1", "1+1+1", "john (at) mail [dot] example dot org", "+1 2.3.4.5 6", "\n+49 30\n123456789",
]


def test_awkward_texts_agree_with_plain_patterns(spark):
    rows = found(spark, AWKWARD)
    for i, text in enumerate(AWKWARD):
        agrees(rows[i], text)


def test_random_texts_agree_with_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["1", "22", "333", "255", ".", "-", " ", "(", ")", "+", "@", "a", "b.c", "_", "4736962573099581", "ß", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(800)]
    rows = found(spark, texts)
    for i, text in enumerate(texts):
        agrees(rows[i], text)


def test_places_of_many_matches(spark):
    texts = ["ab " * 1000, "", None, "x", "ab", "😀ab😀ab"]
    got = docs_of(spark, texts).select("doc_id", matches.places(F.col("text"), "ab", 3).alias("p")).collect()
    for r in got:
        want = [(m.start(), m.end(), m[0]) for m in re.finditer("ab", texts[r["doc_id"]] or "")]
        assert [(p["start"], p["end"], p["value"]) for p in r["p"]] == want


def test_numbers_beside_each_other_and_without_prefix_are_added(spark):
    rng = random.Random(9)

    def phone():
        return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"

    texts = []
    for i in range(1500):
        kind = i % 5
        texts.append(
            ["call ", "pay by ", "from ", "see page ", "part no "][kind]
            + [phone(), card(rng), ".".join(str(rng.randrange(256)) for _ in range(4)),
               str(rng.randrange(10_000)), str(rng.randrange(10**7, 10**9))][kind] + " and so on"
        )
    first = len(texts)
    p, c = phone(), card(rng)
    texts += [f"both {p} {c} here", "national (377) 555-0271 here", "plain words only", "order 1234567 of 2024"]
    rows = found(spark, texts)
    for i, text in enumerate(texts):
        agrees(rows[i], text)
    spans = rows[first]["spans"].split(",")
    assert f"likely_phone:5:{5 + len(p)}" in spans
    assert f"likely_card:{6 + len(p)}:{6 + len(p) + len(c)}" in spans
    assert rows[first + 1]["spans"] == "likely_phone:9:23"
    assert rows[first + 2]["spans"] == "" and rows[first + 3]["spans"] == ""
    assert [(texts[i], rows[i]["spans"]) for i in range(first) if rows[i]["n_likely"]] == []


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert pii.find_personal_data(docs_of(spark, [])).collect() == []
    rows = [(7, "a@b.cd"), (7, "a@b.cd"), (7, "1.2.3.4"), (None, "a@b.cd"), (None, None)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == sorted(
        [("7", "email:0:6"), ("7", "email:0:6"), ("7", "ip:0:7"), ("None", "email:0:6"), ("None", "")]
    )


def test_thresholds_need_precision_and_examples():
    bins = [(0, 99, 50.0, 50.0), (0, 60, 40.0, 44.0), (0, 10, 1.0, 90.0), (1, 99, 5.0, 5.0), (2, 50, 10.0, 60.0)]
    assert pii.thresholds(bins, 0.95) == {0: 0.6}


def test_no_python_in_the_plan(spark, small):
    from passageworks.llm.queries import QUERIES

    plan = QUERIES["op13_pii_boosting"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("value,right", [("4111111111111111", True), ("4111111111111112", False), ("1" * 20, False), ("", False)])
def test_luhn(spark, value, right):
    assert spark.range(1).select(pii.luhn(F.lit(value))).first()[0] is right

"""Likeness against the multisets themselves, and the order of ranges with hot and null ids."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import multiset

#: Above this, an estimate is wrong: some sixty standard errors, or two colliding paragraphs of a short text.
ERROR = 0.005


def counts(text):
    return Counter(p for p in re.split(r"\n+|(?<=[.!?]) +", text or "") if p)


def plain(a, b):
    a, b = counts(a), counts(b)
    both = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
    return 1.0 if a == b else 2 * sum(v * b[k] for k, v in a.items()) / both


def edited(text, nxt):
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def near(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(multiset.likeness(multiset.of_text(F.col("a")), multiset.of_text(F.col("b"))).alias("near")).collect()
    return [r["near"] for r in got]


@pytest.mark.parametrize("n", [1, 3, 300, 3000, 10_000])
def test_likeness_holds_for_any_length(spark, n):
    a, b = ("\n".join(f"{side} {k}" for k in range(n)) for side in ("left", "right"))
    half = "\n".join(f"left {k}" if k % 2 else f"other {k}" for k in range(n))
    pairs = [(a, b), (a, half), (a, a), (a, ""), ("", ""), (a + "\n" + b, b), (a * 1, a + "\nmore")]
    for got, (x, y) in zip(near(spark, pairs), pairs, strict=True):
        assert abs(got - plain(x, y)) < ERROR


def test_likeness_with_repeats(spark):
    pairs = [("one\n" * 100, "two\n" * 100), ("one\n" * 100, "one\n" * 50), ("one\n" * 100 + "a\nb\nc", "one\na\nb\nc"), ("x\ny", "y\nx\nx")]
    for got, (x, y) in zip(near(spark, pairs), pairs, strict=True):
        assert abs(got - plain(x, y)) < ERROR


def test_every_row_against_the_multisets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in multiset.fingerprint_and_edit(docs).collect()}
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        assert abs(got[i]["near_next"] - plain(text, nxt)) < ERROR
        assert abs(got[i]["near_edited"] - plain(text, edited(text, nxt))) < ERROR
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(by_text.values())) == len({frozenset(counts(t).items()) for t in by_text})


def test_wide_places_are_independent(spark):
    fp = spark.range(1).select(multiset.of_text(F.lit("a\nb")).alias("a"), multiset.of_text(F.lit("b")).alias("b")).first()
    assert len(set(fp["a"]["wide"])) == len(set(fp["b"]["wide"])) == multiset.WIDE and 0 not in fp["b"]["wide"]
    assert len({(x - y) % (1 << 62) for x, y in zip(fp["a"]["wide"], fp["b"]["wide"], strict=True)}) == multiset.WIDE


def test_hot_and_null_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(multiset, "RANGE_ROWS", 20)
    rows = [(k, f"text {k}") for k in range(200)] + [(77, f"hot {k}") for k in range(150)] + [(None, f"null {k}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]), reverse=True)
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = multiset.with_next(df)
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in got.collect()) == want
    ranged = multiset._ranges(df.withColumn("h", F.xxhash64("text"))).groupBy("rng", "sub").count()
    assert ranged.agg(F.max("count")).first()[0] < 75

"""Chat formatting, mixing, sharding, the oracles, and the pipeline against a plain version."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import chat, mixing, sharding
from tidewheel.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), c.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[list(got.columns)].values.tolist()))


@pytest.mark.parametrize("name", ["op1_chat", "op5_multiset", "op9_mixing"])
def test_native(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 2, "bob", "hi <|im_end|>"), (1, 1, "ann", "hello"), (1, 1, "ann", "hello"), (1, 3, None, None), (2, 0, "system", "x"), (None, None, "ann", "no id")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, speaker string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "bob"]
    start = "<|im_start|>system\nrules<|im_end|>\n" + "<|im_start|>user name=ann\nhello<|im_end|>\n" * 2
    assert r["rendered"] == start + "<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert r["turn_mask"] == "00010" and (r["n_turns"], r["n_assistant"]) == (5, 1)
    assert [r["rendered"][s["start"] : s["end"]] for s in r["spans"]] == ["hi <\\|im_end|><|im_end|>"]
    assert [got[1, "ann"]["rendered"][s["start"] : s["end"]] for s in got[1, "ann"]["spans"]] == ["hello<|im_end|>"] * 2
    parts = sorted((r["part"], r["rendered"]) for r in chat.rotate(df.filter("conv_id = 1"), part_turns=2).filter("speaker = 'bob'").collect())
    assert len(parts) == 2 and "".join(t for _, t in parts) == r["rendered"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_mixing(make, odd):
    rows = [*odd, *[(50 + k, "word " * (k % 40), None, "abc"[k % 3]) for k in range(300)]]
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows) and mixing.mix(make([])).count() == 0
    size = Counter()
    for _, text, _, source in (r if len(r) > 3 else (*r, None) for r in rows):
        size[source] += len((text or "").encode().split())
    source_of = defaultdict(set)
    for r in rows:
        source_of[r[0]].add(r[3])
    taken, target = Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        if len(source_of[r["doc_id"]]) == 1:
            (s,) = source_of[r["doc_id"]]
            assert r["source_size"] == size[s]
            taken[s] += r["taken"]
            target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    assert all(target[s] <= 2 * size[s] for s in target)
    again = mixing.mix(make(rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_targets(spark):
    rows = [("a", "a", 1000), ("b", "b", 10), ("c", "c", 10)]  # b and c are filled, a takes the rest
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()}
    assert got == {"a": 1530 - 40, "b": 20, "c": 20}


def test_sharding(spark, make, odd):
    rows = [*odd, *[(100 + k, f"text {k % 900} " * 5) for k in range(3000)], *[(9000 + k, "the same text in many rows") for k in range(1500)]]
    got = sharding.shard(make(rows), fine=16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard(make([])).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by = sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in by) / 16
    assert len(by) == 16 and all(abs(r["b"] - mean) < 0.05 * mean for r in by)


def test_equal_rows_and_groups(make):
    """Rows that are the same in every column are spread like any others; small groups of equal texts keep together."""
    rows = [(7, "the same row again and again")] * 3000 + [(100 + k, f"text {k} of its own") for k in range(3000)]
    rows += [(5000 + k, f"group {k // 20}") for k in range(600)]
    got = sharding.shard(make(rows)).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert len(size) == 16 and max(size.values()) < 1.15 * sum(size.values()) / 16
    assert all(len(where[zlib.crc32(f"group {k}".encode())]) == 1 for k in range(30))
    assert sorted(r["slot"] for r in got if r["shard"] == 3) == list(range(sum(r["shard"] == 3 for r in got)))


def test_a_long_conversation_is_many_groups(spark):
    """One conversation with most turns: its parts are joined, ordered and rendered apart."""
    rows = [(1, k, ("ann", "bob", "cy")[k % 3], f"turn {k}") for k in range(3000)] + [(2, k, "ann", "hi") for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.rotate(df, part_turns=100).filter("conv_id = 1 and speaker = 'bob'").orderBy("part").collect()
    assert [r["n_turns"] for r in got] == [100] * 30
    whole = chat.rotate(df, part_turns=10_000).filter("conv_id = 1 and speaker = 'bob'").first()
    assert "".join(r["rendered"] for r in got) == whole["rendered"] and "".join(r["turn_mask"] for r in got) == whole["turn_mask"]


def test_write_shards(make, odd, tmp_path):
    docs = make(odd, extra=False)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd) and set(docs.columns) <= set(back.columns)


def test_pipeline(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "bpe"]
    stage = dict(c.STAGES)
    before = {r["doc_id"]: r for r in docs.collect()}
    # line dedup: every line of 10 documents or more is left once, in the first of them
    lines = stage["line dedup"](spark, docs, small).collect()
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    n = Counter(k for r in before.values() for k in {key(x) for x in r["text"].split("\n")} - {b""})
    left = Counter(k for r in lines for k in map(key, r["text"].split("\n")))
    assert all(left[k] == 1 for k, m in n.items() if m >= 10) and len(lines) == len(before)
    assert all(left[k] >= m for k, m in n.items() if m < 10) and all(len(r["text"]) == r["n_chars"] for r in lines)
    # near copies: exactly one row of each component of an exact Jaccard similarity of 0.8 or more
    kept = [r["doc_id"] for r in stage["simhash near-dedup"](spark, docs, small).select("doc_id").collect()]
    from test_near import brute

    assert sorted(kept) == sorted({comp for _, comp in brute([(i, r["text"]) for i, r in before.items()])})
    # mixing: rows as often as the mix takes them
    mixed = Counter(r["doc_id"] for r in stage["mixing"](spark, docs, small).select("doc_id").collect())
    assert mixed == Counter({r["doc_id"]: r["n_taken"] for r in mixing.mix(docs).collect() if r["n_taken"]})
    for name, f in c.STAGES[:-1]:
        assert f(spark, docs, small).columns == docs.columns, name
    out = c.run(spark, small)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} and out.count() > 0
    assert out.filter("n_tokens <> size(ids)").count() == 0


OWN_NAMES = ("_id", "_size", "_k", "_turn", "_n", "_stay", "_row", "_crc", "_shard", "n_taken", "taken", "key", "chunk", "own", "upto", "row", "t", "score", "kept", "n_dropped", "at", "nth", "number")


def test_pipeline_stages_take_odd_rows(spark, make, odd, small):
    import corpus_pipeline as c

    docs = make(odd, extra=False).withColumns({x: F.concat(F.lit(x), "text") for x in OWN_NAMES})
    whole = {tuple(r) for r in docs.collect()}
    for name, f in c.STAGES:
        got = f(spark, docs, small)
        if name != "bpe":
            assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= whole, name
        assert f(spark, docs.limit(0), small).count() == 0


def test_mixing_stage_takes_the_rows_that_the_mix_took(spark):
    import corpus_pipeline as c

    rows = [(i, f"{s} " * 3, s, k) for k, (i, s) in enumerate([(1, "b"), (1, "c"), (1, "a"), (None, "a"), (None, "c"), (2, "c"), (2, "c")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, nr int")
    mixed = mixing.mix(docs, carry=("nr",)).collect()
    got = Counter(r["nr"] for r in dict(c.STAGES)["mixing"](spark, docs, "").collect())
    assert got == Counter({r["nr"]: r["n_taken"] for r in mixed if r["n_taken"]}) and len(mixed) == len(rows)
    size = Counter(r[2] for r in rows)
    assert all(r["source_size"] == 3 * size[rows[r["nr"]][2]] for r in mixed)


def test_many_rows_without_ids_are_cut_into_chunks(spark):
    docs = spark.createDataFrame([(None, f"text {k} " * (k % 9), "a") for k in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).agg(F.sum("taken"), F.max("target")).first()
    assert 0 <= got[1] - got[0] < 18
    assert docs.select(F.md5(F.concat_ws(":", F.lit("mix"), "doc_id", F.md5(F.col("text").cast("binary"))).cast("binary")).alias("key")).select(F.substring("key", 1, 1)).distinct().count() == 16

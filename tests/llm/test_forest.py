import numpy as np

from tidewheel.llm.forest import TREES, nearest

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            c = [(-((b * a).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(c)[:k]]
    return out


def test_exact_on_small_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(150, rows[7][1]), (300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [None] * 8), (500, []), (None, rows[1][1]), (550, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).repartition(5)
    got = {}
    for r in nearest(df, "vec_id % 50 = 0", share=float(TREES)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert got == {q: [(i, s) for i, s in w] for q, w in want.items() if w}
    assert nearest(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = brute(rows)
    hits = total = 0
    got = {}
    for r in nearest(df, "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, w in want.items():
        hits += len(got[q] & {i for i, _ in w})
        total += len(w)
    assert hits >= 0.9 * total


def test_blocks_by_prefix(spark, monkeypatch):
    """Many small blocks, every one reached: the result is exact, copies and other magnitudes included."""
    from tidewheel.llm import forest

    monkeypatch.setattr(forest, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((200, 6))
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(1000 + i, rows_[1]) for i in range(60) for rows_ in [(0, [float(x) for x in v[3]])]]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int").repartition(6)
    got = {}
    for r in nearest(df, "vec_id % 50 = 0", share=float(TREES)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows)


def test_any_magnitude(spark):
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-1.0, 0.5, 2.0], [3.0, 1.0, 0.0]]
    for size in (1e-200, 1e-300, 1e200, 1e300, 5e-324):
        rows = [(50 * i, [x * size for x in e]) for i, e in enumerate(base)]
        got = nearest(spark.createDataFrame([r for r in rows if any(r[1])], "vec_id long, embedding array<double>"), "vec_id = 0", k=2).orderBy("rank").collect()
        assert len(got) == 2 and all(-1 <= r["score"] <= 1.0000001 for r in got)
        if size > 1e-300:
            assert got[0]["vec_id"] == 50 and abs(got[0]["score"] - 0.99993) < 1e-4


def test_candidates_are_a_small_share_where_vectors_cluster():
    from tidewheel.llm.forest import fit

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 32))
    v = centres[rng.integers(0, 60, 6000)] + 0.1 * rng.standard_normal((6000, 32))
    share, reach = fit(v, 5, 6)
    assert share <= 0.3 and reach <= 3

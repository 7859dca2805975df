"""Near copies against brute-force Jaccard."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from tidewheel.llm.near import near_components


def plain_set(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows):
    """Counter-like sorted list of (id, least id of the component), all pairs compared."""
    sets = [plain_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) > 0:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, least.get(find(k))) for k, (i, *_) in enumerate(rows)), key=repr)


def edited(rows, rnd):
    """Groups of edited copies around 0.8, short and long, with one common passage."""
    common = " ".join(f"licence{k}" for k in range(40))
    for g in range(12):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice((8, 30, 120, 400)))]
        for k in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 9)}"
            rows.append((1000 + 100 * g + k, " ".join(w) + (" " + common if g % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"HOT": 8, "SMALL": 3, "SEGMENT_KEYS": 500}, {"CANDIDATES": 1, "FEW": 0}, {"CANDIDATES": 1, "FEW": 0, "HELD": 5}])
def test_components_match_brute_jaccard(make, odd, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(sys.modules["tidewheel.llm.near"], name, value)
    rows = edited(list(odd), random.Random(3))
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_components(make(rows)).collect()), key=repr)
    assert got == brute(rows)
    assert near_components(make([])).count() == 0


def test_pipeline_stage_drops_edited_copies(make):
    import corpus_pipeline as c

    rows = edited([], random.Random(4))
    kept = {r["doc_id"] for r in dict(c.STAGES)["simhash near-dedup"](None, make(rows), "").collect()}
    assert kept == {comp for _, comp in brute(rows)}


def test_rows_not_ids_decide(spark):
    import corpus_pipeline as c

    text = " ".join(f"word{k}" for k in range(40))
    rows = [(0, text, "a"), (1, text, "b"), (1, "something else entirely that has more than five words", "c"), (None, text, "d"), (None, "only without an id, and twice", "e"), (None, "only without an id, and twice", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stay string").withColumns({x: F.lit(7) for x in ("id", "h", "root", "at", "nth", "row", "number", "a.b")})
    got = dict(c.STAGES)["simhash near-dedup"](spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["_stay"]) for r in got.collect() if r["doc_id"] is not None) == [(0, "a"), (1, "c")]
    assert [r["_stay"] for r in got.filter("doc_id is null").collect()] == ["e"]


def alike(n, rnd):
    """A group of texts of which every two share a good half of their shingles, and few four fifths."""
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(2, 6)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"MEMBERS": 40, "HELD": 500}, {"SHINGLES": 5000, "CANDIDATES": 16, "LANES": 64}])
def test_a_group_that_is_alike_lists_no_pairs(make, monkeypatch, bounds):
    near = sys.modules["tidewheel.llm.near"]
    made, real = [], near.over_batches

    def counted(df, f, schema):
        out = near.cut(real(df, f, schema))
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "over_batches", counted)
    for name, value in bounds.items():
        monkeypatch.setattr(near, name, value)
    rows = alike(400, random.Random(6))
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_components(make(rows)).collect()), key=repr)
    assert got == brute(rows)
    blocks = 1 if not bounds else 16
    # the first counts shingles; a group of 400 has 79800 pairs
    assert len(rows) <= max(made[1:]) <= blocks * len(rows)

"""Multiset fingerprints, line dedup, toxicity and language ID."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import langid, linededup, multiset
from tidewheel.llm.langid import identify
from tidewheel.llm.toxicity import MIXED, fit_counts, tokens, toxicity

SMALL = "/root/testdata/sf0.1"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_multiset_is_homomorphic(spark):
    a, b = "one line\ntwo lines\none line", "three. four!\nfive"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    fa, fb = multiset.of_text(F.col("a")), multiset.of_text(F.col("b"))
    r = df.select(
        multiset.as_hex(multiset.combine(fa, fb)).alias("sum"), multiset.as_hex(multiset.of_text(F.concat("b", F.lit("\n"), "a"))).alias("joined"),
        multiset.as_hex(multiset.combine(multiset.combine(fa, fb), multiset.negate(fb))).alias("back"), multiset.as_hex(fa).alias("fa"),
        multiset.as_hex(multiset.remove(multiset.add(fa, F.lit("new")), F.lit("new"))).alias("same"), multiset.as_hex(multiset.add(fa, F.lit("new"))).alias("more"),
        multiset.likeness(fa, fa).alias("one"), multiset.likeness(multiset.of_text(F.lit("alpha\nbeta\ngamma")), fb).alias("none"),
    ).first()
    assert r["sum"] == r["joined"] and r["back"] == r["fa"] == r["same"] != r["more"]
    assert r["one"] == 1 and r["none"] == 0


def test_fingerprint_and_edit(make, odd):
    rows = odd
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    order = sorted(rows, key=key, reverse=True)
    texts = [r[1] or "" for r in order]
    want = Counter()
    for k, r in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        want[(r[0], len(t), sha(t[: len(t) - half] + nxt[:half]))] += 1
    got = multiset.fingerprint_and_edit(make(rows).repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert multiset.fingerprint_and_edit(make([])).count() == 0
    assert multiset.fingerprint_and_edit(make([(1, "alone")])).first()["near_next"] == 1


def test_ranges_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(multiset, "RANGE_ROWS", 7)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), reverse=True)
    want = {i: (t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)}
    assert {r["doc_id"]: (r["text"], r["next_text"]) for r in multiset.with_next(df).collect()} == want


def test_likeness_of_edits(spark):
    r = multiset.fingerprint_and_edit(spark.read.parquet(f"{SMALL}/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert 0.4 < r[0] < 0.6 and r[1] < 0.15


def lines_brute(rows, min_docs, keep):
    texts = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n, first = Counter(), {}
    for i, lines in texts:
        for k in {key(x) for x in lines} - {""}:
            n[k] += 1
            first[k] = min(first.get(k, float("inf")), float("inf") if i is None else i)
    out = []
    for i, lines in texts:
        kept, done = [], set()
        for x in lines:
            k = key(x)
            if n[k] >= min_docs:
                if keep == "none" or first[k] != (float("inf") if i is None else i) or k in done:
                    continue
                done.add(k)
            kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bound", [None, 0])
def test_line_dedup(make, odd, keep, bound):
    rows = [*odd, *[(20 + k, f"shared LINE \nown {k}\n shared line\n\nSecond line here") for k in range(12)]]
    how = {} if bound is None else {"max_filter_bytes": bound, "max_keys_bytes": bound}
    for min_docs in (2, 10):
        got = linededup.digest(linededup.dedup_lines(make(rows), min_docs=min_docs, keep=keep, **how)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == lines_brute(rows, min_docs, keep)
    assert linededup.dedup_lines(make([]), keep=keep, **how).count() == 0


def test_filters_have_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = linededup._Filters()
    f.add(h, False)
    f.add(h[:500], False)
    f.add(rng.integers(0, 1 << 63, 300, dtype=np.uint64), True)
    at = linededup._probes(h)
    seen = f.twice[at[0]] & f.twice[at[1]] & f.twice[at[2]]
    assert seen[:500].all() and seen[500:].mean() < 0.05


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in held)
    assert hit >= 0.8 * sum(r["toxic"] for r in held) and hit >= 0.85 * sum(r["predicted"] for r in held)


def test_toxicity_of_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (7, 1, 0), (9, 1, 0), (5, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(make(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in toxicity(make(odd), labels.limit(0)).collect()} == {0.0}
    assert toxicity(make([]), labels).count() == 0


def plain_kneser_ney(docs, discount):
    """docs: (class, words) -> a function from words to the evidence, by dictionaries."""
    pairs = {y: Counter(g for c, t in docs if c == y for g in zip(["<s>", *t[:-1]], t, strict=True)) for y in (0, 1)}
    cont = {y: Counter(w for _, w in pairs[y]) for y in (0, 1)}
    types = len(cont[0]) + len(cont[1])
    cut = lambda n: max(n - (0, 1.0, 1.6, 2.2)[min(n, 3)], 0)

    def unigram(y, w):
        n = {c: cont[c][w] for c in (0, 1)}
        if sum(n.values()) <= 1 and sum(k for c in (0, 1) for (v, _), k in pairs[c].items() if v == w) <= 1:
            n = {0: 0, 1: 0}  # left to the backoff for new words
        classes = (n[0] > 0) + (n[1] > 0)
        total = sum(cont[y].values())
        free = total - sum(cut(k) for k in cont[y].values())
        return (cut(n[y]) + free * max(0.5, classes - 0.5) / types) / total

    def p(y, v, w):
        after = {g: k for g, k in pairs[y].items() if g[0] == v}
        total = sum(after.values())
        if sum(k for c in (0, 1) for g, k in pairs[c].items() if g[0] == v) <= 1 and cont[0][v] + cont[1][v] <= 1 or not total:
            return unigram(y, w)
        left = sum(min(k, discount) for k in after.values())
        return (max(after.get((v, w), 0) - discount, 0) + left * unigram(y, w)) / total

    def evidence(t):
        ratio = [p(1, v, w) / p(0, v, w) for v, w in zip(["<s>", *t[:-1]], t, strict=True)]
        return sum(math.log(1 + MIXED * (r - 1)) for r in ratio) / len(t)

    return evidence


@pytest.mark.parametrize("discount", [2.0, 8.0])
def test_evidence_is_that_of_plain_counts(spark, discount):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    say = lambda y: rnd.choices(words, [1 + (k < 6) * 8 + y * (k > 34) * 3 for k in range(40)], k=rnd.randint(1, 60))
    docs = [(y, say(y)) for y in (0, 0, 0, 1) for _ in range(15)]
    asked = [say(k % 2) for k in range(20)] + [["new", "words"], ["w1", "new", "w2", "w3"]]
    hashed = lambda rows: spark.createDataFrame([(y, " ".join(t)) for y, t in rows], "y int, text string").select("y", tokens(F.col("text")).alias("t"))
    (model,) = fit_counts(hashed(docs), (discount,))
    want = plain_kneser_ney(docs, discount)
    for r, t in zip(hashed([(0, t) for t in asked]).collect(), asked, strict=True):
        got, n = model.evidence(np.array(r["t"], np.int64), np.array([0, len(t)]))
        assert n[0] == len(t) and got[0] == pytest.approx(want(t), rel=1e-5, abs=1e-9)


def test_ftrl_is_that_of_plain_numbers():
    """Follow-the-regularised-leader, a weight at a time, beside the arrays."""
    rnd = random.Random(4)
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= langid.L1:
            return 0.0
        sign = 1 if z[k] > 0 else -1
        return -(z[k] - sign * langid.L1) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    model = langid.Ftrl(3)
    for _ in range(200):
        at, y = sorted(rnd.sample(range(12), 4)), rnd.randrange(3)
        x = [rnd.random() for _ in at]
        logits = [sum(weight((i, c)) * v for i, v in zip(at, x, strict=True)) for c in range(3)]
        e = [math.exp(v - max(logits)) for v in logits]
        w = {(i, c): weight((i, c)) for i in at for c in range(3)}
        for i, v in zip(at, x, strict=True):
            for c in range(3):
                g = (e[c] / sum(e) - (c == y)) * v
                old = n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[i, c]
                n[i, c] = old + g * g
        model.learn(np.array(at), np.array(x), y)
    assert np.allclose(model.weights(slice(0, 12)), [[weight((i, c)) for c in range(3)] for i in range(12)])


def test_any_number_of_languages(make):
    rows = [(k, f"word{chr(0x4E00 + k // 5)} {chr(0x4E00 + k // 5) * 6}", f"lang{k // 5}") for k in range(2500)]
    got = identify(make(rows), max_fit_docs=1000).collect()
    assert len({r["lang_pred"] for r in got}) > 450  # more languages than any constant, each of them learned
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 0)
    hot = [(one, f"the same id, another text {k}", "en") for k in range(3000)] + [(100 + k, f"noch ein anderer text {k}", "de") for k in range(30)]
    assert {r["lang_pred"] for r in identify(make(hot), max_fit_docs=50).collect()} == {"en", "de"}


def test_language(spark, make, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    got = identify(make(odd)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd) and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 10))
    assert all(r["lang_pred"] == "und" or r["lang_pred"] in ("en", "de", "fr") and 0 < r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in identify(make([(1, "some text", None)])).collect()} == {"und"}
    assert identify(make([])).count() == 0

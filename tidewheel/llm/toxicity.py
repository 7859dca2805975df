"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models over lower-cased words are learned, one of the toxic and one of the
ordinary documents.  Both back off from pairs to their class's continuation counts and from those
to counts that both classes share (in how many classes a word occurs), so that what is rare, or new,
counts equally for both.  A toxic document is mostly ordinary words, so the model of toxic documents draws a
word from the toxic counts with the probability ``MIXED`` and from the ordinary ones else.  The log-likelihoods under it and under the
ordinary model, both normalised by the number of words, are compared, and a logistic function turns their difference into a
score from 0 to 1; there both classes weigh the same, whatever their sizes and however many of them were sampled.

Models are learned from labelled documents outside the held-out fold, at most ``max_fit_docs`` of each class
(those with the smallest hash of the id).  One further fold isn't learned from at first: on it the discount of pairs
(from ``PAIR_DISCOUNTS``, by log-likelihood) and the logistic function are fitted; then the counts are taken from it too.
Words that occur once, and pairs that the discount takes whole, are left to the backoff.
That bounds the tables, which are broadcast: 40 bytes an n-gram.  Scoring reads nothing but the text.

A null text is empty; a document without words has the score of no evidence.  A document with
labels that differ is toxic; of rows with the same id the one with the least text is learned from.  Null labels and
null ids aren't learned from; a null id is not held out.  Repeated rows are scored each.  Without labels of both kinds every score is 0.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import crc_fold, cut, over_batches, with_fields

MAX_FIT_DOCS = 10_000
#: Share of a toxic document's words that come from the toxic model; the others are ordinary words.
MIXED = 0.005
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
#: Discounts of counts 1, 2 and over: what occurs once is all backoff.
DISCOUNTS = (1.0, 1.6, 2.2)
#: Discounts of a pair of words to choose from.
PAIR_DISCOUNTS = (2.0, 4.0, 8.0, 16.0, 32.0)
START = 0
#: Tokens scored at once.
PORTION = 1 << 18


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for two words."""
    a = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((a ^ (a >> np.uint64(29))) + w.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def discounted(n: np.ndarray) -> np.ndarray:
    d = np.where(n >= 3, DISCOUNTS[2], np.where(n >= 2, DISCOUNTS[1], DISCOUNTS[0]))
    return np.maximum(n - d, 0.0)


@dataclass
class Models:
    """Sorted tables; columns of class 0 (ordinary) and 1 (toxic)."""

    words: np.ndarray  # hashes
    unigram: np.ndarray  # (words, 2) continuation probability with backoff
    unseen: np.ndarray  # (2,) the same of a word in no table
    context: np.ndarray  # (words, 2) occurrences as a context
    left: np.ndarray  # (words, 2) mass that the context leaves to the backoff
    pairs: np.ndarray  # hashes
    counts: np.ndarray  # (pairs, 2)
    discount: float
    a: float = 1.0
    b: float = 0.0

    def evidence(self, t: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood by token of toxic less that of ordinary, tokens) of each document."""
        n = np.diff(offsets)
        if not len(t):
            return np.zeros(len(n)), n
        v = np.empty_like(t)
        v[1:] = t[:-1]
        v[offsets[:-1][n > 0]] = START
        w_at, w_in = _find(self.words, t)
        p = np.where(w_in[:, None], self.unigram[w_at], self.unseen)
        v_at, v_in = np.empty_like(w_at), np.empty_like(w_in)
        v_at[1:], v_in[1:] = w_at[:-1], w_in[:-1]
        first = offsets[:-1][n > 0]
        v_at[first], v_in[first] = (int(x[0]) for x in _find(self.words, np.array([START])))
        total = np.where(v_in[:, None], self.context[v_at], 0.0)
        both, found = _find(self.pairs, pair(v, t))
        got = np.where(found[:, None], np.maximum(self.counts[both] - self.discount, 0.0), 0.0)
        p = np.where(total > 0, (got + self.left[v_at] * p) / np.maximum(total, 1), p)
        d = np.log1p(MIXED * (p[:, 1] / p[:, 0] - 1))
        sums = np.concatenate([[0.0], np.cumsum(d)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1), n

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * x + self.b, -40, 40)))


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def unigrams(cont: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 2) probabilities of words with these continuation counts, and (2,) of a new word.

    totals: (2, 2) for each class the distinct pairs and the types, words that aren't in the table included.
    """
    kept = discounted(cont)
    # Kneser-Ney once more, with the class as the context: a word's shared count is the number of
    # classes that have it, less a half that goes to new words
    types = totals[:, 1].sum()
    p_shared = ((cont > 0).sum(axis=1) - 0.5).clip(0.5) / types
    p_new = 0.5 / types
    free = totals[:, 0] - kept.sum(axis=0)
    return (kept + free[None, :] * p_shared[:, None]) / totals[:, 0][None, :], free * p_new / totals[:, 0]


def fit_counts(t: DataFrame, discounts: tuple[float, ...]) -> list[Models]:
    """A model for each discount of pairs, from rows (y, t): class and tokens; none without words of both classes."""
    grams = t.select("y", F.explode(F.arrays_zip(F.concat(F.array(F.lit(START).cast("long")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))).alias("v"), F.col("t").alias("w"))).alias("g"))
    grams = grams.select("y", "g.v", "g.w").filter("w is not null")
    pairs = cut(grams.groupBy("v", "w").agg(F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1")))
    one = lambda c: F.count_if(F.col(c) > 0)
    cont = pairs.groupBy("w").agg(one("c0").alias("n0"), one("c1").alias("n1"))
    cont = cut(cont)
    totals = cont.agg(F.sum("n0"), F.sum("n1"), one("n0"), one("n1")).first()
    if not totals[0] or not totals[1]:
        return []
    left = [F.sum(F.least(F.col(f"c{y}").cast("double"), F.lit(d))).alias(f"l{y}_{i}") for i, d in enumerate(discounts) for y in (0, 1)]
    context = pairs.groupBy("v").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"), *left)
    word = cont.filter("n0 + n1 > 1").join(context.filter("s0 + s1 > 1").withColumnRenamed("v", "w"), "w", "full")
    columns = [c for c in word.columns if c != "w"]
    u = word.select("w", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).toPandas().sort_values("w")
    if not len(u):
        return []
    b = pairs.filter(F.greatest("c0", "c1") > min(discounts)).select("v", "w", "c0", "c1").toPandas()
    key = pair(b["v"].to_numpy(np.int64), b["w"].to_numpy(np.int64))
    order = np.argsort(key)
    key, count = key[order], b[["c0", "c1"]].to_numpy(np.float32)[order]
    if not len(key):
        key, count = np.array([START]), np.zeros((1, 2), np.float32)
    p, unseen = unigrams(u[["n0", "n1"]].to_numpy(), np.array([[totals[0], totals[2]], [totals[1], totals[3]]], np.float64))
    words, total = u["w"].to_numpy(np.int64), u[["s0", "s1"]].to_numpy()
    return [Models(words, p, unseen, total, u[[f"l0_{i}", f"l1_{i}"]].to_numpy(), key, count, d) for i, d in enumerate(discounts)]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(a, b, loss): logistic regression of the labels on the evidence, by Newton's method with a light penalty."""
    f = np.stack([x, np.ones_like(x)], axis=1)
    scale = np.maximum(np.sqrt((f * f).mean(axis=0)), 1e-12)
    f = f / scale
    beta, penalty = np.zeros(2), np.array([1e-2, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        g = f.T @ (weight * (p - y)) + penalty * beta
        h = (f * (weight * p * (1 - p))[:, None]).T @ f + np.diag(penalty)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    a, b = (beta / scale).tolist()
    p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
    return a, b, float(-(weight * np.log(np.where(y > 0, p, 1 - p))).mean())


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their tokens, offsets): parts of the batches with PORTION tokens, or one document."""
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy().astype(np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PORTION, side="right")) - 1)
            t = batch.column(1).values.slice(ends[a], ends[b] - ends[a]).to_numpy(zero_copy_only=False)
            yield batch.slice(a, b - a), t.astype(np.int64, copy=False), ends[a : b + 1] - ends[a]
            a = b


def _evidence(batches: Iterator[pa.RecordBatch], models: list[Models]) -> Iterator[pa.RecordBatch]:
    """(y, tokens, evidence of each model)."""
    for part, t, offsets in _portions(batches):
        x, n = zip(*(m.evidence(t, offsets) for m in models), strict=True)
        each = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(x, axis=1).ravel()), len(models)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n[0]), each], names=["y", "n", "x"])


def _scores(batches: Iterator[pa.RecordBatch], m: Models) -> Iterator[pa.RecordBatch]:
    """(doc_id, carried columns, score)."""
    for part, t, offsets in _portions(batches):
        rest = [part.column(i) for i in range(2, part.num_columns)]
        score = pa.array(m.score(m.evidence(t, offsets)[0]))
        yield pa.RecordBatch.from_arrays([part.column(0), *rest, score], names=[str(i) for i in range(len(rest) + 2)])


def labelled(docs: DataFrame, labels: DataFrame, max_fit_docs: int) -> DataFrame:
    """(doc_id, y, fold, t) of the documents to learn from, at most ``max_fit_docs`` of a class."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"), crc_fold("doc_id", FOLDS).alias("fold"))
    known = known.filter(f"id is not null and y in (0, 1) and fold <> {HELD_OUT}").groupBy("id").agg(F.max("y").alias("y"), F.first("fold").alias("fold"))
    known = cut(known)
    pick = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_fit_docs) for y in (0, 1)]
    chosen = F.broadcast(pick[0].union(pick[1]))  # max_fit_docs bounds it
    d = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id")
    d = d.groupBy("id", "y", "fold").agg(F.min("text").alias("text"))
    return cut(d.select(F.col("id").alias("doc_id"), "y", "fold", tokens(F.col("text")).alias("t")))


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Models | None:
    """Counts without the calibration fold say which discount to take and how to calibrate; the models then learn from all."""
    rows = labelled(docs, labels, max_fit_docs)
    parts = fit_counts(rows.filter(F.col("fold") != CALIBRATE), PAIR_DISCOUNTS)
    best, a, b = PAIR_DISCOUNTS[-1], 1.0, 0.0
    if parts:
        sent = docs.sparkSession.sparkContext.broadcast(parts)
        seen = rows.filter(F.col("fold") == CALIBRATE).select(F.col("y").cast("double"), "t")
        got = over_batches(seen, lambda it: _evidence(it, sent.value), "y double, n long, x array<double>").filter("n > 0").toPandas()
        y = got["y"].to_numpy()
        if 0 < y.sum() < len(y):
            x, weight = np.stack(got["x"].to_numpy()), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
            fits = [calibrate(x[:, i], y, weight) for i in range(len(parts))]
            i = min(range(len(fits)), key=lambda i: fits[i][2])
            best, (a, b, _) = PAIR_DISCOUNTS[i], fits[i]
        sent.destroy()
    models = fit_counts(rows, (best,))
    if not models:
        return None
    models[0].a, models[0].b = a, b
    return models[0]


def score(docs: DataFrame, models: Models | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``carry``, score of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("t"), *carry)
    if models is None:
        return d.select("doc_id", *carry, F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(models)
    return over_batches(d, lambda it: _scores(it, sent.value), with_fields("doc_id long", d, carry, "score double"))


def toxicity(docs: DataFrame, labels: DataFrame, *, max_fit_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    s = score(docs, fit(docs, labels, max_fit_docs))
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to ``MAX_N``-grams of a text's lower-cased letters (other characters count as one
blank), hashed to ``DIM`` places, with sublinear term frequencies, inverse document
frequencies over all documents to learn from, and unit length.  Weights are trained with
follow-the-regularised-leader and an elastic net (L1 keeps them sparse, L2 small), then one
temperature is fitted on documents that training hasn't seen, which calibrates the probabilities.

Training takes at most ``max_fit_docs`` documents, an equal share of each language as far as it has them (those with the
smallest hash of id and text, one at least); document frequencies take all documents of the learning folds.
Every language there is is learned: the model has ``DIM`` weights of 4 bytes for each, training four times as much.
Scoring reads whole texts, and nothing else.

A text that is null or has no letter is ``und`` with score 0.  Rows without a language
or an id aren't learned from; a null id is not held out.  Repeated rows count each.  Without
languages to learn every row is ``und``; with one, it is always that one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import crc_fold, over_batches

DIM, MAX_N = 1 << 15, 3
MAX_FIT_DOCS = 3000
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: Follow-the-regularised-leader: step, smoothing, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-4, 1e-4, 4

_MULT = np.uint32(0x9E3779B1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a text's n-grams; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(c)
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0)
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one blank for a run of others
    c = c[keep]
    counts = np.zeros(DIM, np.int32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * _MULT
        counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1), minlength=DIM).astype(np.int32)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float64)


_known = None


def _letters(c: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _known
    if _known is None:
        _known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _known[c]


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the best log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    def __init__(self, names: list[str], w: np.ndarray, idf: np.ndarray, t: float):
        self.names, self.w, self.idf, self.t = names, w.astype(np.float32), idf.astype(np.float32), t

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text)
        if not len(at):
            return "und", 0.0
        p = softmax(weigh(at, counts, self.idf) @ self.w[at] / self.t)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, documents of this task that have it), place -1 for their number."""
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for x in batch.column(0):
            at, _ = features(x.as_py())
            df[at] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["at", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in (1, 2, 3)), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in got], pa.binary())],
            names=["lang", "fold", "u", "at", "counts"],
        )


def fit(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> LanguageModel | None:
    d = docs.select(F.col("text"), F.col("lang").alias("lang"), F.col("doc_id").cast("long").alias("id"), crc_fold("doc_id", FOLDS).alias("fold"))
    d = d.filter(f"lang is not null and text is not null and id is not null and fold <> {HELD_OUT}")
    d = d.withColumn("u", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30))
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("low")).collect()
    if not sizes:
        return None
    names = sorted(r["lang"] for r in sizes)
    share = max(1, max_fit_docs // len(names))
    # about `share` documents of each language, by a threshold on the hash of the id; then exactly
    rates = [(r["lang"], max(r["low"], min(1.0, (1.5 * share + 20) / r["n"]))) for r in sizes]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))  # a row for each language
    drawn = d.join(rates, "lang").filter("u <= rate")
    sample = over_batches(drawn.select("text", "lang", "fold", "u"), _vectors, "lang string, fold long, u double, at binary, counts binary")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("u", "at", "counts"))
    sample = sample.withColumn("nth", nth).filter(F.col("nth") <= share).select("lang", "fold", "at", "counts")
    rows = sorted((r["lang"], r["fold"], bytes(r["at"]), bytes(r["counts"])) for r in sample.collect())
    df = over_batches(d.select("text"), _frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    total = int(df.loc[df["at"] == -1, "df"].sum())
    df = df[df["at"] >= 0]
    full = np.zeros(DIM)
    full[df["at"].to_numpy()] = df["df"].to_numpy()
    idf = _idf(full, total)
    number = {name: i for i, name in enumerate(names)}
    data = [(number[lang], fold, np.frombuffer(at, np.int32), np.frombuffer(counts, np.float32).astype(np.float64)) for lang, fold, at, counts in rows]
    data = [(y, fold, at, weigh(at, counts, idf)) for y, fold, at, counts in data if len(at)]
    if not data:
        return None
    train = [x for x in data if x[1] != CALIBRATE] or data
    model, rng = Ftrl(len(names)), np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, _, at, x = train[i]
            model.learn(at, x, y)
    w = model.weights(slice(None))
    seen = [x for x in data if x[1] == CALIBRATE]
    logits = np.array([x @ w[at] for _, _, at, x in seen]) if seen else np.zeros((0, len(names)))
    return LanguageModel(names, w, idf, temperature(logits, np.array([y for y, *_ in seen], np.int64)))


def identify(docs: DataFrame, *, max_fit_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    model = fit(docs, max_fit_docs)
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if model is None:
        return d.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(x.as_py()) for x in batch.column(2)]
            names, scores = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return over_batches(d, run, "doc_id long, held_out boolean, lang_pred string, score double")

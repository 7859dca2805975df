"""Approximate nearest neighbours with a hash-prefix forest.

A tree gives every vector a hash string of ``BITS`` sign bits of random projections and is
a sorted array of those strings.  A query descends each tree to the entries with the longest
prefix in common with its own string, then ascends in all trees at once, to shorter
and shorter prefixes, until enough candidates are met.  Candidates are ranked by their
exact cosine in double precision.

* Equal vectors are one entry; of its ids only the smallest can be among the nearest, and only they are kept.
* Entries are dealt to blocks by the prefix of one further string, which has as many bits as make blocks of about ``BLOCK_ROWS``;
  a prefix with more entries is cut into several blocks.  Every block has a forest of its own.
* Queries are rows too.  A query goes to the blocks whose prefix differs from its own in at most ``reach`` bits, and stands behind their entries
  there, so a task holds one block and a batch of queries, and neither the driver nor a broadcast holds any vector.
* A block gives a query its nearest few, and the nearest of those are the result.

Reach and the number of candidates that are enough (as a share of a block) are fitted on a bounded sample
of ``FIT_ROWS`` entries: the smallest with a measured recall of ``FIT_RECALL`` each.
Clustered vectors need little of both, vectors without structure much.

Vectors that are null, zero or hold null or non-finite components take no part, as
queries or candidates; nor do rows without an id.  Components of any magnitude are fine: vectors are scaled by a power of two.  Repeated rows (an id and
its vector twice) are candidates twice.  A query's own row is any row with its id; an id with several vectors asks with the least of them.  Vectors of
another length are of another space and ignored by a query; each length is a search of its own.  No vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, over_batches

BITS, TREES, BLOCK_ROWS = 16, 96, 8192
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 8192, 128, 0.97
#: Queries that a block answers at once.
ASKED = 64
#: Entries to meet, as a share of a block, an entry counting once for each tree that meets it; the last meets all.
LADDER = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0, 40.0, float(TREES))
#: Bits of the string whose prefix deals entries to blocks, at most.
ROUTE_BITS = 24


def projections(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(20_240_131 + dim).standard_normal((dim, trees * bits))


def routes(dim: int) -> np.ndarray:
    return np.random.default_rng(77_000 + dim).standard_normal((dim, ROUTE_BITS))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component below 1; cosines are the same to the last bit."""
    _, e = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -e[:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def prefixes(v: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of the vectors' routing strings, as numbers."""
    signs = v @ routes(v.shape[1])[:, :bits] > 0
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=1) if bits else np.zeros(len(v), np.int64)


class Forest:
    """Sorted arrays over the vectors of a block (scaled, double precision)."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.vectors, self.trees, self.bits, self.planes = vectors, trees, bits, planes
        self.norms = norms(vectors)
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(trees, rows): hash strings as integers, first bit highest."""
        out = np.empty((self.trees, len(v)), np.int32)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int32)
        for a in range(0, len(v), 1024):
            signs = (v[a : a + 1024] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[:, a : a + 1024] = (signs * weights).sum(axis=2).T
        return out

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees) starts and ends in the sorted arrays, at each query's level."""
        q = self.codes(queries)
        low, high = (np.empty((self.bits + 1, len(queries), self.trees), np.int32) for _ in range(2))
        for t in range(self.trees):
            for level in range(self.bits + 1):
                rest = self.bits - level
                first = q[t] >> rest << rest
                low[level, :, t] = np.searchsorted(self.sorted[t], first)
                high[level, :, t] = np.searchsorted(self.sorted[t], first + (1 << rest))
        met = (high - low).sum(axis=2)  # level by query, all trees together
        level = np.maximum((met >= enough).sum(axis=0) - 1, 0)  # counts fall with the level
        each = np.arange(len(queries))
        return low[level, each], high[level, each]

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        for a in range(0, len(queries), ASKED):
            low, high = self.ranges(queries[a : a + ASKED], enough)
            for lo, hi in zip(low, high, strict=True):
                seen = np.zeros(len(self.vectors), bool)
                seen[np.concatenate([self.order[t, lo[t] : hi[t]] for t in range(self.trees)])] = True
                yield np.flatnonzero(seen)

    def search(self, queries: np.ndarray, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidates, cosines) of each query."""
        for q, n, at in zip(queries, norms(queries), self.candidates(queries, enough), strict=True):
            yield at, (self.vectors[at] * q).sum(axis=1) / (n * self.norms[at])


def fit(sample: np.ndarray, k: int, bits: int, recall: float = FIT_RECALL) -> tuple[float, int]:
    """(candidates to meet as a share of the entries, reach) for ``recall`` of the true nearest in the sample each."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= k + 1:
        return LADDER[-1], bits
    ask = np.random.default_rng(7).choice(len(sample), min(FIT_QUERIES, len(sample)), replace=False)
    forest = Forest(sample, projections(sample.shape[1]))
    unit = sample / forest.norms[:, None]
    cos = unit[ask] @ unit.T
    cos[np.arange(len(ask)), ask] = -2
    true = np.argsort(-cos, axis=1)[:, :k]
    to = prefixes(sample, bits)
    apart = np.bitwise_count((to[ask][:, None] ^ to[true]).astype(np.uint64))
    reach = next(r for r in range(bits + 1) if (apart <= r).mean() >= recall)
    for share in LADDER:
        found = forest.candidates(sample[ask], max(1, int(share * len(sample))))
        hits = sum(np.isin(t, at).sum() for t, at in zip(true, found, strict=True))
        if hits >= recall * true.size:
            return share, reach
    return LADDER[-1], reach


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _with_prefix(batches: Iterator[pa.RecordBatch], dim: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(ids, embedding) -> (prefix, ids, embedding)."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(prefixes(_matrix(b.column(1), dim), bits)), *b.columns], names=["prefix", "ids", "embedding"])


def _answers(batches: Iterator[pa.RecordBatch], dim: int, k: int, share: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, asks, ids, embedding), a block's entries before its queries -> (query_id, vec_id, score): each block's nearest k."""
    planes = projections(dim)
    now, ids, held, forest = None, [], [], None

    def nearest(own: int, at: np.ndarray, cos: np.ndarray) -> list[tuple[float, int]]:
        if len(at) > k + 1:  # one entry may be the query itself only
            keep = cos >= np.partition(cos, len(cos) - k - 1)[len(cos) - k - 1]
            at, cos = at[keep], cos[keep]
        got = sorted((-c, x) for a, c in zip(at.tolist(), cos.tolist(), strict=True) for x in ids[a] if x != own)
        return got[:k]

    for b in batches:
        block, asks = b.column(0).to_pylist(), b.column(1).to_pylist()
        edges = [0, *(i for i in range(1, len(block)) if block[i] != block[i - 1] or asks[i] != asks[i - 1]), len(block)]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if block[a] != now:
                now, ids, held, forest = block[a], [], [], None
            part, v = b.column(2).slice(a, z - a).to_pylist(), _matrix(b.column(3).slice(a, z - a), dim)
            if not asks[a]:
                ids += part
                held.append(v)
                continue
            if forest is None and held:
                forest, held = Forest(np.concatenate(held), planes), []
            if forest is None:
                continue
            out = []
            for (own,), (at, cos) in zip(part, forest.search(v, max(1, int(share * len(ids)))), strict=True):
                out += [(own, x, -c) for c, x in nearest(own, at, cos)]
            q, x, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])


def _search(same: DataFrame, dim: int, is_query: str, k: int, share: float | None) -> DataFrame:
    """``nearest`` among the vectors of one length."""
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    kept = same.withColumn("nth", first).filter(F.col("nth") <= k + 1)  # more ids of one vector can't be among k
    entries = kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")
    n = kept.filter("nth = 1").count()
    bits = min(ROUTE_BITS, max(0, (max(1, n) - 1) // BLOCK_ROWS).bit_length())
    reach = bits
    if share is None:
        rate = FIT_ROWS / max(1, n)  # about FIT_ROWS by a threshold on the hash; the limit bounds it
        due = F.pmod(F.xxhash64(F.lit("fit"), "embedding"), F.lit(1 << 30)) < int(rate * (1 << 30))
        sample = same.filter(due).select("embedding").distinct().limit(2 * FIT_ROWS).collect()
        share, reach = fit(scaled(np.array([r[0] for r in sample], np.float64).reshape(-1, dim)), k, bits)
    routed = lambda d: over_batches(d, lambda it: _with_prefix(it, dim, bits), "prefix long, ids array<bigint>, embedding array<double>")
    entries = cut(routed(entries))
    sizes = entries.groupBy("prefix").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("subs"))
    sub = F.pmod(F.xxhash64("embedding"), F.col("subs"))
    rows = entries.join(sizes, "prefix").select(F.concat_ws(":", "prefix", sub).alias("block"), F.lit(False).alias("asks"), "ids", "embedding")
    ask = same.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.array("vec_id").alias("ids"), "embedding")
    near = routed(ask)
    if bits:
        all_ = F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long"))
        reached = F.filter(all_, lambda x: F.bit_count(x.bitwiseXOR(F.col("prefix"))) <= reach)
        near = near.select(F.explode(reached).alias("prefix"), "ids", "embedding")
    near = near.join(sizes, "prefix").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    near = near.select(F.concat_ws(":", "prefix", "sub").alias("block"), F.lit(True).alias("asks"), "ids", "embedding")
    parts = rows.union(near).repartition("block").sortWithinPartitions("block", "asks")
    return over_batches(parts, lambda it: _answers(it, dim, k, share), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: str, k: int = 5, *, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that meets ``is_query`` (SQL), but its own."""
    v = _usable(vectors)
    found = None
    for r in v.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        part = _search(v.filter(F.size("embedding") == r["d"]), r["d"], is_query, k, share)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cut(found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

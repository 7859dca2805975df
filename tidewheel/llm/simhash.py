"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has 64 bits; a bit is 1 if it is 1 in over half of the XXH64 hashes
(seed 42) of its shingles.  Words are runs of anything but \\x20 and \\x09-\\x0D after
lower-casing A-Z; fewer words than a shingle has make one shingle of all; none give 0.

Texts link when their fingerprints differ in ``radius`` bits or fewer.  Equal
fingerprints are one class from the start, so copies are never compared.  Classes that
can link share ``parts - radius`` of the fingerprint's parts (pigeonhole), which makes
the keys.  The members of a key's bucket are compared in blocks of vertical bit planes:
for a block, word w of plane b holds bit b of 64 fingerprints; carry-save counters add
up 64 distances at once, and a block is left as soon as all its distances exceed the
radius.  Of the links found in a block, only those of a spanning forest go on; no pairs
of a group are listed, and components come out the same.

A bucket of more than ``cap`` classes isn't compared: its members are linked exactly
through the fingerprints that lie between them.  For a radius of 2, two fingerprints
link if and only if they have a common neighbour at a distance of 1 or less, and such a
neighbour has 65 members at most, however large the bucket.  For other radii buckets
are cut into blocks that are compared two by two, in as many tasks.

Null texts count as empty.  Null ids are kept: they never name a component unless no
member has an id.  Repeated rows give repeated rows.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, over_batches, utf8
from tidewheel.llm.components import connected_components

#: Fingerprints compared with each other in one block, at least.
BLOCK = 512


def simhash_text(text: bytes, words: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()  # past the space behind each word
    starts = [0, *ends[: len(w) - words]]
    h = np.fromiter(
        [xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)], np.uint64
    )
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash_text(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), run, "doc_id long, fp long")


# -- bit-sliced comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): bit b of 64 fingerprints in each word of plane b.  Fingerprints have 64 bits, or 64 for each column."""
    lanes, wide = -(-len(fps) // 64) * 64, fps[:, None] if fps.ndim == 1 else fps
    bits = np.zeros((lanes, 64 * wide.shape[1]), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(wide).astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query index, lane) of every distance of ``radius`` or less; ``n`` lanes are in use."""
    digits = (radius + 1).bit_length()
    queries = queries[:, None] if queries.ndim == 1 else queries
    shape = (len(queries), planes.shape[1])
    counter = [np.zeros(shape, np.uint64) for _ in range(digits)]
    over = np.zeros(shape, np.uint64)
    everywhere = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(len(planes)):
        ask = (queries[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1)
        carry = planes[b][None, :] ^ (np.uint64(0) - ask)[:, None]
        for d in range(digits):  # add one bit to all counters of the block
            carry, counter[d] = counter[d] & carry, counter[d] ^ carry
        over |= carry
        if b % 8 == 7:
            over |= _above(counter, radius)
            if (over == everywhere).all():  # every distance exceeds the radius: leave the block
                break
    over |= _above(counter, radius)
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.nonzero(near)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is more than ``radius``."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for d in reversed(range(len(counter))):
        if radius >> d & 1:
            equal = equal & counter[d]
        else:
            above = above | (equal & counter[d])
            equal = equal & ~counter[d]
    return above


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest member reached) that span the components of a block of fingerprints."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return []
    a, b = within(fps, bit_planes(fps), len(fps), radius)
    keep = a > b
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    signed = fps.view(np.int64)
    return [(int(signed[x]), int(signed[find(x)])) for x in range(len(fps)) if find(x) != x]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) in the order of k: whole buckets, packed to blocks of BLOCK rows or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(part: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        got = forest(np.concatenate([f for _, f in part]).view(np.uint64), radius) if part else []
        u, v = zip(*got, strict=True) if got else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and sum(len(x) for x, _ in held) >= BLOCK and held[-1][0][0] != k[a]:
                yield flush(held)
                held = []
            held.append((k[a:b], f[a:b]))
    yield flush(held)


def _keys(radius: int, parts: int):
    """An array of one key (a long) for every choice of parts that two linked fingerprints can share."""
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << (b - a)) - 1 << (64 - b) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for n, chosen in enumerate(combinations(range(parts), parts - radius)):
        mask = F.lit(signed(sum(masks[i] for i in chosen))).cast("long")
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(mask)))
    return F.array(*keys)


def near_links(classes: DataFrame, radius: int = 2, parts: int | None = None, cap: int = 1024) -> DataFrame:
    """(u, v): links between the distinct fingerprints ``fp`` that span the components of all links."""
    parts = parts or radius + 2
    keyed = classes.select(F.explode(_keys(radius, parts)).alias("k"), "fp")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    live = cut(keyed.join(sizes, "k"))
    small = live.filter(F.col("n") <= cap).select("k", "fp")
    small = small.repartition("k").sortWithinPartitions("k")
    links = over_batches(small, lambda it: _links(it, radius), "u long, v long")
    large = live.filter(F.col("n") > cap)
    if radius == 2:
        hot = large.select("fp").distinct()
        steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        met = hot.select("fp", F.explode(F.transform(steps, lambda s: F.col("fp").bitwiseXOR(s))).alias("mid"))
        met = met.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
        more = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    else:
        blocks = large.withColumn("m", F.ceil(F.col("n") / cap)).withColumn("b", F.pmod(F.xxhash64("fp", "k"), F.col("m")))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("o")
        two = blocks.select("k", "fp", "b", other).select(
            F.xxhash64("k", F.least("b", "o"), F.greatest("b", "o")).alias("k"), "fp"
        )
        more = over_batches(two.repartition("k").sortWithinPartitions("k"), lambda it: _links(it, radius), "u long, v long")
    return links.union(more)


def simhash_components(
    docs: DataFrame, *, words: int = 3, radius: int = 2, parts: int | None = None, cap: int = 1024
) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 hex digits), component_id of every row of ``docs``."""
    fps = cut(fingerprints(docs, words))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(classes.select("fp"), radius, parts, cap)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

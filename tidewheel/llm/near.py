"""Near copies by exact Jaccard similarity of shingle sets, with bit-sliced SimHash as the candidate search.

Texts with the same set of shingles are one class.  Two classes link if they share at least four
fifths of their shingles (Jaccard).  Classes that might link are gathered into families, and a family's members
are compared on their sets, so nothing below four fifths links.

* Keys: in an order of shingles that all texts share, sets of a similarity t have a common shingle among the
  first n - ceil(t n) + 1 of each.  The order puts shingles that are common in a sample last, which
  only serves speed.
* Fingerprints: SimHash of the distinct shingles, 128 bits in two words.  A bit differs with a chance of 0.15 to 0.19 at four
  fifths, so ``RADIUS`` is over four standard deviations above; of unrelated texts one pair in some thousands is as near.
* Min-wise bits: a bit of the least of the set's hashes, under 64 ``WORDS`` hash functions.  A bit differs with a chance of 0.1 at four fifths;
  ``APART`` is five standard deviations above and rules out most pairs below 0.6.
* Families: components of the classes that share a key and are near by both.  A task of the search gives only links that span the components of its
  buckets, so no pairs of a group are listed.  A few keys of every class go first; then all keys, with what the few have joined as one node.
  Within a bucket, members of its largest component are never compared with each other.
* Sets: a family's sets meet in one place, or in blocks two by two; rarest shingles first, prefixes give the pairs that are counted out exactly.
* Keys travel packed, by segment of the hash space; a key of more than ``HOT`` classes is cut into blocks that are compared two by two.

Null texts count as empty; texts without words are one class.  Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, over_batches, utf8
from tidewheel.llm.components import connected_components
from tidewheel.llm.simhash import bit_planes, within

#: Distance of fingerprints up to which classes are one family; words of min-wise bits, and how many bits may differ.
RADIUS, WORDS, APART = 44, 3, 40
#: Documents whose shingles are counted, and common shingles kept at most.
SAMPLE, COMMON = 4096, 200_000
#: Keys of a class that go first; classes of a bucket that look for candidates at once, and classes that they meet at once.
FEW, CANDIDATES, LANES = 4, 256, 2048
#: Keys of a segment; classes of a key up to which they are compared in one place; of a bucket up to which they are compared one by one.
SEGMENT_KEYS, HOT, SMALL = 1 << 18, 1 << 18, 12
#: Members and shingles of a family, or a block of one; shingles of candidates that are counted at once.
MEMBERS, SHINGLES, HELD = 2048, 1 << 20, 1 << 19
#: Bits of a portion of the filter of texts whose sets are needed, and portions at most (64 MB).
FILTER_BITS, FILTERS = 1 << 20, 512

_XOR, _FACTOR = np.random.default_rng(11).integers(0, 1 << 32, (2, 64 * WORDS), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends[: len(w) - words]]
    return np.unique(np.fromiter([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)], np.uint64))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits: the SimHash of the shingles' hashes, and that of what another mixing makes of them."""
    again = (s ^ (s >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    again = again ^ (again >> np.uint64(29))
    both = np.stack([s, again], axis=1).astype(">u8").view(np.uint8).reshape(len(s), 16)
    ones = np.unpackbits(both, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(s)).tobytes()
    return int.from_bytes(bits[:8], "big"), int.from_bytes(bits[8:], "big")


def _minwise(s: np.ndarray) -> list[int]:
    """``WORDS`` words of a bit each of the least shingle under a hash function."""
    s, least = s.astype(np.uint32), np.full(64 * WORDS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(s), 1024):
        hashed = s[at : at + 1024, None] ^ _XOR
        hashed *= _FACTOR
        least = np.minimum(least, hashed.min(axis=0))
    return np.packbits((least >> np.uint32(12)).astype(np.uint8) & 1).view(np.uint64).tolist()


def _set_id(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.tobytes(), 7)


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more documents of a sample, in order, and how many have them."""
    n = docs.count()
    some = docs.select(utf8().alias("text"))
    if n > SAMPLE:
        some = some.filter(F.pmod(F.xxhash64("text"), F.lit(-(-n // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(shingle_set(x.as_py(), words).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["x", "n"])

    # a text with very many copies is sampled with all of them or not at all: once is enough
    top = over_batches(some.distinct(), run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter("n > 2")
    rows = top.orderBy(F.desc("n"), "x").limit(COMMON).collect()
    x, c = np.array([r["x"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(x)
    return x[order], c[order]


def _prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which two similar sets share one at least."""
    n = len(s)
    if not n:
        return s
    x, c = common
    rank = np.zeros(n, np.int64)
    if len(x):
        at = np.minimum(np.searchsorted(x, s), len(x) - 1)
        rank = np.where(x[at] == s, c[at], 0)
    return s[np.lexsort((s, rank))[: n - -(-4 * n // 5) + 1]]


#: Columns of the bits that are compared.
_BITS = ("fp", "fq", *(f"w{k}" for k in range(WORDS)))


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """(id, t, h, fp, fq, w0 to w2, size, few, keys) of every row (id, text); t is the text's hash and h that of its set."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def few(keys: np.ndarray, most: int = FEW) -> np.ndarray:
        drawn = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return keys[np.argsort(drawn)[:most]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda xs: pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(2)]
            words_ = [(_set_id(s), *_fingerprint(s), *_minwise(s)) for s in sets]
            words_ = [pa.array(x) for x in np.array(words_, np.uint64).reshape(-1, 3 + WORDS).T.copy().view(np.int64)]
            keys = [_prefix(s, common.value) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *words_, pa.array([len(s) for s in sets], pa.int64()), longs(map(few, keys)), longs(keys)],
                names=["id", "t", "h", *_BITS, "size", "few", "keys"],
            )

    rows = docs.select("id", F.xxhash64(utf8()).alias("t"), utf8().alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    return over_batches(rows, run, f"id {id_type}, t long, h long, {', '.join(f'{c} long' for c in _BITS)}, size long, few array<bigint>, keys array<bigint>")


def _filter(t: DataFrame) -> dict[int, np.ndarray]:
    """A filter (16 bits for each of the longs ``t``, up to 64 MB; fuller beyond), by segment."""
    segments = max(1, min(FILTERS, -(-t.count() * 16 // FILTER_BITS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            seg = batch.column(0).to_numpy()
            for s in np.unique(seg).tolist():
                bits.setdefault(s, np.zeros(FILTER_BITS, bool))[_probes(h[seg == s])] = True
        packed = pa.array([np.packbits(b).tobytes() for b in bits.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), packed], names=["seg", "bits"])

    seg = F.pmod(F.col("t"), F.lit(segments)).alias("seg")
    rows = over_batches(t.select(seg, "t").repartition(min(segments, 64), "seg"), build, "seg long, bits binary").collect()
    return {"segments": segments, **{r["seg"]: np.frombuffer(r["bits"], np.uint8) for r in rows}}


def _probes(h: np.ndarray) -> np.ndarray:
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.concatenate([((h >> np.uint64(9)) + np.uint64(i) * step) % np.uint64(FILTER_BITS) for i in range(4)]).astype(np.int64)


def _may_have(filters: dict, t: np.ndarray) -> np.ndarray:
    seg, out = t % filters["segments"], np.zeros(len(t), bool)
    for s in np.unique(seg).tolist():
        if s in filters:
            mine = np.flatnonzero(seg == s)
            at = _probes(t[mine].view(np.uint64)).reshape(4, -1)
            out[mine] = ((filters[s][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0).all(axis=0)
    return out


def _half(s: np.ndarray) -> np.ndarray:
    """The set by 32 bits of each hash, which is enough to compare two texts."""
    return np.unique(s.astype(np.uint32))


# -- families


def _packed(batches: Iterator[pa.RecordBatch], segments: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (root, bits, keys) -> (segment, rows (k, root, bits) packed)."""
    wide = 1 + len(_BITS)
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        seg = (rows[:, 0].view(np.uint64) >> np.uint64(20)) % np.uint64(segments)
        order = np.argsort(seg, kind="stable")
        rows, seg = rows[order], seg[order]
        edges = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
        blobs = [rows[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(seg[edges[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["seg", "rows"])
        held.clear()

    hot_keys = np.array(sorted(hot), np.int64)
    for batch in batches:
        ends = batch.column(wide).offsets.to_numpy()
        k = batch.column(wide).flatten().to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        each = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        rows = np.stack([k, *(batch.column(i).to_numpy()[each] for i in range(wide))], axis=1)
        is_hot = np.isin(k, hot_keys)
        held.append(rows[~is_hot])
        for key in np.unique(k[is_hot]).tolist():  # blocks of a hot key meet two by two
            mine, m = rows[k == key], -(-hot[key] // HOT)
            block = (((mine[:, 2] ^ mine[:, 4]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(m)
            for other in range(m):
                lo, hi = np.minimum(block, other), np.maximum(block, other)
                copy = mine.copy()
                copy[:, 0] = (np.uint64(key % (1 << 64)) + (lo * np.uint64(m) + hi + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                held.append(copy)
        if sum(map(len, held)) >= 1 << 19:
            yield from out()
    if held:
        yield from out()


def _hot_keys(classes: DataFrame, total: int) -> dict[int, int]:
    """Keys of more than HOT classes and their number, about; total / HOT of them at most."""
    if total <= HOT:
        return {}
    n = classes.select(F.explode("keys").alias("k")).groupBy("k").count().filter(F.col("count") > HOT)
    return {r["k"]: r["count"] for r in n.collect()}


def _ends(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the pointers of ``x`` end."""
    r = parent[x]
    while (parent[r] != r).any():
        r = parent[r]
    parent[x] = r
    return r


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _ends(parent, a), _ends(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _bucket_forest(rows: np.ndarray, at_once: int, small: int) -> np.ndarray:
    """Links (root, root) that span the components of the buckets of these rows (k, root, bits)."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    k, words, wise = rows[:, 0], np.ascontiguousarray(rows[:, 2:4]).view(np.uint64), np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
    roots, x = np.unique(rows[:, 1], return_inverse=True)
    parent = np.arange(len(roots))
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    mixed = np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)

    def near(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.bitwise_count(wise[i] ^ wise[j]).sum(axis=1) <= APART
        _join(parent, x[i[ok]], x[j[ok]])

    some = np.flatnonzero(np.repeat(mixed & (sizes <= small), sizes))
    for d in range(1, small):
        i = some[some < len(k) - d]
        i = i[(k[i] == k[i + d]) & (x[i] != x[i + d])]
        i = i[np.bitwise_count(words[i] ^ words[i + d]).sum(axis=1) <= RADIUS]
        near(i, i + d)
    for a, n in zip(starts[mixed & (sizes > small)].tolist(), sizes[mixed & (sizes > small)].tolist(), strict=True):
        f, y, todo, planes = words[a : a + n], x[a : a + n], np.ones(n, bool), None
        while True:  # who isn't in the largest component yet meets all others, once
            r = _ends(parent, y)
            each, counts = np.unique(r, return_counts=True)
            q = np.flatnonzero(todo & (r != each[counts.argmax()]))[:at_once]
            if not len(q):
                break
            todo[q] = False
            planes = planes or [bit_planes(f[b : b + LANES]) for b in range(0, n, LANES)]
            for b, plane in enumerate(planes):
                i, j = within(f[q], plane, min(LANES, n - b * LANES), RADIUS)
                i, j = q[i], j + b * LANES
                apart = r[i] != r[j]
                near(i[apart] + a, j[apart] + a)
    to = _ends(parent, np.arange(len(roots)))
    moved = np.flatnonzero(to != np.arange(len(roots)))
    return np.stack([roots[moved], roots[to[moved]]], axis=1)


def _forests(batches: Iterator[pa.RecordBatch], at_once: int, small: int) -> Iterator[pa.RecordBatch]:
    """Rows (seg, rows) in the order of segments -> (u, v): links that span the components of a segment."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2 + len(_BITS)) for x in held])
        links = _bucket_forest(rows, at_once, small)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    for batch in batches:
        for seg, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if seg != now:
                if held:
                    yield out()
                now, held = seg, []
            held.append(rows.as_buffer())
    if held:
        yield out()


def _near_links(classes: DataFrame, keys: str, roots: DataFrame | None, hot: dict[int, int]) -> DataFrame:
    """(u, v): links that span the families by these keys; classes with the same root are one already."""
    total = classes.agg(F.sum(F.size(keys))).first()[0] or 0
    segments, at_once, small = max(1, -(-total // SEGMENT_KEYS)), CANDIDATES, SMALL
    if roots is None:
        rooted = classes.withColumn("root", F.col("h"))
    else:
        rooted = classes.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    packed = over_batches(rooted.select("root", *_BITS, keys), lambda it: _packed(it, segments, hot), "seg long, rows binary")
    parts = packed.repartition(segments, "seg").sortWithinPartitions("seg")
    return over_batches(parts, lambda it: _forests(it, at_once, small), "u long, v long")


# -- the sets of a family


def _exact_links(sets: list[np.ndarray], held: int) -> list[tuple[int, int]]:
    """Links (place, place) from each set's component of sets that share four fifths: its first member, the set."""
    n = np.array([len(s) for s in sets])
    members = len(sets)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(ids)
    owner = np.repeat(np.arange(members), n)
    ids = ids[np.lexsort((ids, often[ids], owner))]  # rarest first in each set
    ends = np.cumsum(n)
    begins = ends - n
    prefix = np.arange(len(ids)) - begins[owner] < (n - -(-4 * n // 5) + 1)[owner]
    prefix &= often[ids] > 1
    keys, has = ids[prefix], owner[prefix]
    order = np.argsort(keys, kind="stable")
    posted = has[order]
    first = np.searchsorted(keys[order], keys)
    last = np.searchsorted(keys[order], keys, "right")
    own = np.searchsorted(has, np.arange(members + 1))
    label, there = np.arange(members), np.zeros(len(often), bool)

    def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = b - a
        return np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())

    for i in range(members):
        met = np.zeros(members, bool)
        mine = slice(own[i], own[i + 1])
        met[posted[ranges(first[mine], last[mine])]] = True
        met[: i + 1] = False
        met &= (label != label[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
        left = np.flatnonzero(met)
        there[ids[begins[i] : ends[i]]] = True
        while len(left):
            m = max(1, int(np.searchsorted(np.cumsum(n[left]), held, "right")))
            part, left = left[:m], left[m:]
            both = np.add.reduceat(there[ids[ranges(begins[part], ends[part])]], np.cumsum(n[part]) - n[part], dtype=np.int64)
            part = part[5 * both >= 4 * (n[i] + n[part] - both)]
            if len(part):
                joined = np.append(label[part], label[i])
                label[np.isin(label, joined)] = joined.min()
                left = left[label[left] != label[i]]
        there[ids[begins[i] : ends[i]]] = False
    return [(int(x), i) for i, x in enumerate(label) if x != i]


def _confirmed(links: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(u, v): links that span the components, within the families that ``links`` make, of classes whose sets share four fifths.

    Only texts that a filter lets through are turned into sets again; nothing else of the documents moves.
    """
    need = classes.select("h", "t", "size").join(connected_components(links).select(F.col("node").alias("h"), F.col("root").alias("f")), "h")
    need = cut(need)
    blocks = need.groupBy("f").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / SHINGLES)).alias("m"))
    filters = docs.sparkSession.sparkContext.broadcast(_filter(need.select("t")))
    held = HELD

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_may_have(filters.value, batch.column(0).to_numpy())))
            s = pa.array([_half(shingle_set(x.as_py(), words)).tobytes() for x in some.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), s], names=["t", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, s = None, [], []

        def out() -> pa.RecordBatch:
            order = np.argsort(np.array(h)).tolist()  # the first is the smallest: all links of a component end there
            got = [(h[order[i]], h[order[j]]) for i, j in _exact_links([s[i] for i in order], held)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            for g, one, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != now:
                    if len(h) > 1:
                        yield out()
                    now, h, s = g, [], []
                h.append(one)
                s.append(np.frombuffer(x.as_buffer(), np.uint32))
        if len(h) > 1:
            yield out()

    found = over_batches(docs.select(F.xxhash64(utf8()).alias("t"), utf8().alias("text")), sets, "t long, s binary")
    placed = need.join(blocks, "f").select("h", "t", "f", "m", F.pmod(F.xxhash64("h", "f"), F.col("m")).alias("b"))
    others = F.when(F.col("m") == 1, F.array("b")).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda o: o != F.col("b")))
    known = found.dropDuplicates(["t"]).join(placed, "t").select("h", "s", "f", "b", F.explode(others).alias("o"))
    met = known.select(F.xxhash64("f", F.least("b", "o"), F.greatest("b", "o")).alias("g"), "h", "s")
    return over_batches(met.repartition("g").sortWithinPartitions("g"), check, "u long, v long")


def jaccard_components(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """id, h, root for every row (id, text): the text's class and the component of classes
    that are linked by a Jaccard similarity of 0.8 or more; equal roots are one component.
    """
    rows = cut(_profiles(docs, words))
    one = rows.groupBy("h").agg(*[F.first(c).alias(c) for c in (*_BITS, "size", "few", "keys")], F.min("t").alias("t"))
    classes = cut(one)
    hot = _hot_keys(classes, classes.agg(F.sum(F.size("keys"))).first()[0] or 0)
    joined = connected_components(cut(_near_links(classes, "few", None, hot)))
    links = cut(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_near_links(classes, "keys", joined, hot)))
    roots = connected_components(cut(_confirmed(links, classes, docs, words))).withColumnRenamed("node", "h")
    return rows.select("id", "h").join(roots, "h", "left").select("id", "h", F.coalesce("root", "h").alias("root"))


def row_hashes(docs: DataFrame) -> Column:
    """A struct of two hashes of a row's values; equal for equal rows."""
    values = [F.col(f"`{c}`") for c in docs.columns]
    nulls = [v.isNull() for v in values]  # hashes skip nulls
    return F.struct(F.xxhash64(*values, *nulls).alias("a"), F.xxhash64(F.lit("b"), *nulls, *values).alias("b"))


def near_components(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id, component_id (the smallest id of the component) of every row of ``docs``."""
    found = jaccard_components(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), words=words)
    smallest = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(smallest, "root").select(F.col("id").alias("doc_id"), "component_id")


def drop_near_copies(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null last), of equal ids the one with the smallest hash of its values."""
    own = docs.select(F.struct("*").alias("row"), row_hashes(docs).alias("at"), F.col("doc_id").cast("long").alias("number"), "text")
    ids = own.select(F.struct(F.col("number").isNull().alias("none"), "number", "at").alias("id"), "text")
    found = jaccard_components(ids, words=words)
    stay = found.groupBy("root").agg(F.min("id").alias("id")).select("id.at")
    kept = own.select("row", "at").join(stay, "at", "left_semi")
    # equal rows are the same but for their place
    nth = F.row_number().over(W.partitionBy("at").orderBy("at"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")

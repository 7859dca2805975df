"""Line deduplication with two Bloom filters, for lines seen once and lines seen twice.

A line's key is the line without \\x20 and \\x09-\\x0D at both ends and with A-Z in lower
case; keys shorter than ``min_chars`` code points are left alone.

1. Every task lists the 64-bit hashes of its documents' keys, each once, with a mark if two of
   its documents have it.  Hashes travel packed, by segment of the hash space.
2. A segment has a Bloom filter for hashes seen once and one for those seen twice; a hash that
   the first filter has already seen enters the second.  The segment's own hashes are then asked of
   the second, and those that it may hold are suspected repeats.  Only they go on.
3. The suspects make a filter of their own, which is far smaller than the lines.  Lines that it may hold shuffle, as
   key and count of documents (added up in each task first), for the exact confirmation.
4. Confirmed lines leave the documents: all of them (``keep="none"``), or all but the first
   occurrence in the order of ids (``keep="first"``).

The filter of the suspects is broadcast in portions of at most ``max_filter_bytes`` (one segment
at least); documents are read once for each portion.  Confirmed keys are broadcast, those of most documents first, up to
``max_keys_bytes``, which is measured; the lines of all others, of which none is in many documents then, are found by a join on the key.

A null or empty text is one empty line.  Null ids come after all others.  Repeated rows are
documents of their own; of rows that tie for the first occurrence, each keeps it.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, over_batches, utf8, with_fields

MAX_FILTER_BYTES = 64 << 20
MAX_KEYS_BYTES = 64 << 20
#: Bits of a segment's filter, and lines that a segment is made for.
SEGMENT_BITS, SEGMENT_LINES, PROBES = 1 << 20, 1 << 17, 3
_SPACE = b" \t\n\x0b\x0c\r"
_EDGE = "\\x20\\x09-\\x0D"


def key_of(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a document that are long enough."""
    keys = {line.strip(_SPACE) for line in text.lower().split(b"\n")}
    if min_chars <= 1:
        keys.discard(b"")
        return keys
    return {k for k in keys if len(k.decode(errors="replace")) >= min_chars}


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """Bit numbers of hashes within their segment."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(SEGMENT_BITS)).astype(np.int64) for i in range(PROBES)]


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int, segments: int) -> Iterator[pa.RecordBatch]:
    """(segment, hashes seen in one document of the task, hashes seen in two or more), packed."""
    from xxhash import xxh64_intdigest

    def packed(once: dict[int, int]) -> Iterator[pa.RecordBatch]:
        h = np.fromiter(once, np.uint64, len(once))
        twice = np.fromiter(once.values(), np.int64, len(once)) > 1
        seg = _segment(h, segments)
        order = np.argsort(seg, kind="stable")
        h, twice, seg = h[order], twice[order], seg[order]
        edges = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)] if len(seg) else [0]
        rows = [(int(seg[a]), h[a:b][~twice[a:b]].tobytes(), h[a:b][twice[a:b]].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["seg", "once", "twice"]
        )

    seen: dict[int, int] = {}
    for batch in batches:
        for x in batch.column(0):
            for k in _keys(x.as_py(), min_chars):
                h = xxh64_intdigest(k)
                seen[h] = seen.get(h, 0) + 1
        if len(seen) > 2_000_000:  # bounds the task's memory
            yield from packed(seen)
            seen = {}
    yield from packed(seen)


class _Filters:
    """The two filters of a segment."""

    def __init__(self) -> None:
        self.once = np.zeros(SEGMENT_BITS, bool)
        self.twice = np.zeros(SEGMENT_BITS, bool)

    def add(self, h: np.ndarray, repeated: bool) -> None:
        """Hashes that differ from each other."""
        at = _probes(h)
        old = np.ones(len(h), bool) if repeated else self.once[at[0]] & self.once[at[1]] & self.once[at[2]]
        # two hashes of one call may complete each other's bits: that is the chance of any false positive
        for p in at:
            self.once[p] = True
            self.twice[p[old]] = True


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_hashes`` in the order of segments -> (segment, the different hashes that the filter for lines seen twice may hold)."""
    now, filters, held = None, None, []

    def out() -> pa.RecordBatch:
        h = np.unique(np.concatenate(held))
        a, b, c = _probes(h)
        h = h[filters.twice[a] & filters.twice[b] & filters.twice[c]]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=["seg", "hashes"])

    for batch in batches:
        for seg, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if seg != now:
                if filters is not None:
                    yield out()
                now, filters, held = seg, _Filters(), []
            for data, repeated in ((once, False), (twice, True)):
                h = np.frombuffer(data, np.uint64)
                filters.add(h, repeated)
                held.append(h)
    if filters is not None:
        yield out()


def _regroup(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """(segment, hashes) -> the same by the fewer segments that suspects need."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)])
        seg = _segment(h, segments)
        found = np.unique(seg).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([h[seg == s].tobytes() for s in found], pa.binary())], names=["seg", "hashes"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, hashes) in the order of segments -> (segment, bits of the suspects' filter)."""
    now, bits = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["seg", "bits"])
    for batch in batches:
        for seg, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if seg != now:
                if bits is not None:
                    yield out()
                now, bits = seg, np.zeros(SEGMENT_BITS, bool)
            for p in _probes(np.frombuffer(hashes.as_buffer(), np.uint64)):
                bits[p] = True
    if bits is not None:
        yield out()


def _count_suspects(batches: Iterator[pa.RecordBatch], min_chars: int, bits: dict[int, bytes], segments: int, ids: bool, portion: range) -> Iterator[pa.RecordBatch]:
    """(key, documents of this task with it, first of them) for keys that the filters of these segments may hold."""
    from xxhash import xxh64_intdigest

    table = {s: np.frombuffer(b, np.uint8) for s, b in bits.items()}
    flat = np.zeros((len(portion), SEGMENT_BITS // 8), np.uint8)
    for s, b in table.items():
        flat[s - portion.start] = b
    flat = flat.reshape(-1)
    found: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        n, first = zip(*found.values(), strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["key", "n", "first"]
        )

    last = (1 << 63) - 1
    for batch in batches:
        id_of = batch.column(1).to_pylist() if ids else None
        for at in range(0, batch.num_rows, 512):
            keys: list[bytes] = []
            owner: list[int] = []
            for r, x in enumerate(batch.column(0).slice(at, 512)):
                k = _keys(x.as_py(), min_chars)
                keys += k
                if ids:
                    owner += [at + r] * len(k)
            h = np.fromiter(map(xxh64_intdigest, keys), np.uint64, len(keys))
            seg = _segment(h, segments)
            here = np.flatnonzero((seg >= portion.start) & (seg < portion.stop))
            base = (seg[here] - portion.start) * SEGMENT_BITS
            hit = np.ones(len(here), bool)
            for p in _probes(h[here]):
                p = p + base
                hit &= (flat[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
            for i in here[hit].tolist():
                k, d = keys[i], (last if not ids or id_of[owner[i]] is None else id_of[owner[i]])
                e = found.get(k)
                if e is None:
                    found[k] = [1, d]
                else:
                    e[0] += 1
                    e[1] = min(e[1], d)
        if len(found) > 500_000:
            yield out()
            found.clear()
    yield out()


def _drop(batches: Iterator[pa.RecordBatch], confirmed: dict[bytes, int], keep_first: bool, min_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, kept text, lines, dropped)."""
    last = (1 << 63) - 1
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, batch.num_rows, 512):
            rows = []
            for i, x in zip(ids[at : at + 512], batch.column(1).slice(at, 512), strict=True):
                lines = x.as_py().split(b"\n")
                out, done = [], set()
                for line in lines:
                    k = key_of(line)
                    first = confirmed.get(k)
                    if first is not None:
                        if not keep_first or first != (last if i is None else i) or k in done:
                            continue
                        done.add(k)
                    out.append(line)
                rows.append((len(lines), len(lines) - len(out), b"\n".join(out)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 512), *[c.slice(at, 512) for c in batch.columns[2:]], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string())],
                names=["doc_id", *batch.schema.names[2:], "n_lines", "n_dropped", "kept"],
            )


def _key_column(line: Column) -> Column:
    stripped = F.regexp_replace(line, f"^[{_EDGE}]+|[{_EDGE}]+\\z", "")
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_lines(
    docs: DataFrame, *, min_docs: int = 2, min_chars: int = 1, max_filter_bytes: int = MAX_FILTER_BYTES, first: bool = True
) -> DataFrame:
    """(key, n, first): the keys of lines that at least ``min_docs`` (2 or more) documents have, and the first id."""
    text = docs.select(utf8().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    n_lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    segments = max(1, -(-n_lines // SEGMENT_LINES))
    by_lines = segments
    packed = over_batches(text.select("text"), lambda it: _hashes(it, min_chars, by_lines), "seg long, once binary, twice binary")
    parts = packed.repartition("seg").sortWithinPartitions("seg")
    suspected = cut(over_batches(parts, _suspects, "seg long, hashes binary"))
    n_suspects = suspected.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    segments = max(1, -(-int(n_suspects) // SEGMENT_LINES))
    fewer = over_batches(suspected, lambda it: _regroup(it, segments), "seg long, hashes binary")
    filters = over_batches(fewer.repartition("seg").sortWithinPartitions("seg"), _bits, "seg long, bits binary")
    step = max(1, max_filter_bytes * 8 // SEGMENT_BITS)
    portions = [range(a, min(a + step, segments)) for a in range(0, segments, step)]
    if len(portions) > 1:
        filters = cut(filters)
    rows = text if first else text.select("text")
    suspects = None
    for portion in portions:
        mine = filters.filter((F.col("seg") >= portion.start) & (F.col("seg") < portion.stop))
        bits = docs.sparkSession.sparkContext.broadcast({r["seg"]: bytes(r["bits"]) for r in mine.collect()})
        count = lambda it, bits=bits, portion=portion: _count_suspects(it, min_chars, bits.value, segments, first, portion)
        found = over_batches(rows, count, "key binary, n long, first long")
        if len(portions) > 1:  # one portion in memory at a time
            found = cut(found.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs))
            bits.destroy()
        suspects = found if suspects is None else suspects.union(found)
    return suspects.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs)


def dedup_lines(
    docs: DataFrame,
    *,
    min_docs: int = 2,
    min_chars: int = 1,
    keep: str = "first",
    carry: tuple[str, ...] = (),
    max_filter_bytes: int = MAX_FILTER_BYTES,
    max_keys_bytes: int = MAX_KEYS_BYTES,
) -> DataFrame:
    """doc_id, the columns named in ``carry``, n_lines, n_dropped, kept (the text that stays) of every row of ``docs``."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    confirmed = cut(repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, max_filter_bytes=max_filter_bytes, first=keep == "first"))
    least = _broadcast_from(confirmed, max_keys_bytes)
    rows = confirmed if least == 0 else confirmed.filter(F.log2(F.col("n")) >= least)
    keys = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in rows.select("key", "first").collect()})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), *[F.col(c) for c in carry])
    schema = with_fields("doc_id long", d, carry, "n_lines long, n_dropped long, kept string")
    out = over_batches(d, lambda it: _drop(it, keys.value, keep == "first", min_chars), schema)
    return out if least == 0 else _drop_by_join(out, confirmed.filter(F.log2(F.col("n")) < least), keep == "first", carry)


def _broadcast_from(confirmed: DataFrame, most_bytes: int) -> int:
    """The smallest power of two (its exponent) such that the keys of at least so many documents weigh ``most_bytes`` or less; 0 for all keys."""
    weight = F.sum(F.octet_length("key") + 100).alias("bytes")  # 100: a dict entry
    classes = confirmed.groupBy(F.floor(F.log2(F.col("n"))).alias("power")).agg(weight).orderBy(F.desc("power")).collect()  # 64 rows at most
    total, least = 0, 64
    for r in classes:
        total += r["bytes"]
        if total > most_bytes:
            return least
        least = int(r["power"])
    return 0


def _drop_by_join(rows: DataFrame, confirmed: DataFrame, keep_first: bool, carry: tuple[str, ...]) -> DataFrame:
    """Rows of ``_drop`` without the lines of further confirmed keys."""
    d = cut(rows.withColumn("row", F.struct(*carry) if carry else F.lit(0)).select(F.monotonically_increasing_id().alias("nr"), "doc_id", "n_lines", "n_dropped", "kept", "row"))
    lines = d.filter("n_dropped < n_lines").select("nr", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.posexplode(F.split("kept", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", _key_column(F.col("line")).cast("binary"))
    hit = lines.select("nr", "id", "pos", "key").join(confirmed.select("key", "first"), "key")
    if keep_first:
        own = F.min(F.when(F.col("first") == F.col("id"), F.col("pos"))).over(W.partitionBy("nr", "key"))
        hit = hit.withColumn("own", own).filter(F.col("own").isNull() | (F.col("pos") != F.col("own")))
    gone = hit.groupBy("nr").agg(F.collect_set("pos").alias("gone"))  # lines of one document
    out = d.join(gone, "nr", "left")
    all_lines = F.split("kept", "\n")
    left = F.filter(F.transform(all_lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("kept")).otherwise(F.array_join(left, "\n"))
    more = F.coalesce(F.size("gone"), F.lit(0))
    more = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(more)
    return out.select("doc_id", *[F.col("row")[c].alias(c) for c in carry], "n_lines", (F.col("n_dropped") + more).cast("long").alias("n_dropped"), text.alias("kept"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT row_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_id) >= 10
), g AS (
  SELECT row_id, count(*) AS n_lines, count(c.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept
  FROM k LEFT JOIN c ON k.key = c.key GROUP BY row_id
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g ON d.row_id = g.row_id
"""

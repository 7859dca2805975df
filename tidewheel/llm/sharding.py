"""Sharding by sampled splitters.

Records are ordered by the hash of their text, so equal texts stand together.  A
sample of keys, drawn by size (the keys with short exponential waiting times, at
the rate of a record's size), gives quantiles that cut the key range into many narrow ranges of about
equal bytes.  A hash that takes more than ``WHOLE`` quantiles for itself is an overfull range; it
becomes a range of its own and is subdivided by row.  The exact bytes of the ranges, in
order, then say which ranges make up a shard, and running counts give slots.

The law is ``bytes``: shards differ by about a range, that is 1 in ``fine`` of a shard, or by a group of equal
texts that is kept whole.  Equal texts share a shard unless their group is subdivided: groups of up to about ``WHOLE`` in ``fine`` of a shard never are.

A record's size is its UTF-8 bytes plus 1; a null text is empty.  Null ids are ids.
Repeated rows get slots of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, over_batches, with_fields

#: Ranges for each shard at least, sampled keys for each range, quantiles of a group that is kept whole.
FINE, PER_RANGE, WHOLE = 64, 16, 4
#: Rows of a range, about, beyond which there are more ranges; ranges for each shard at most.
RANGE_ROWS, MOST_FINE = 1 << 16, 4096


def splitters(keyed: DataFrame, shards: int, fine: int = FINE, per_range: int = PER_RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(ordered splitters, how many quantiles each of them took) from a sample of about shards x fine x per_range keys.

    A key waits for an exponential time at the rate of its size; those that wait less than the time in
    which so many are due are the sample, so every task decides by itself and sends little.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 1
    wait = -F.log((F.pmod(F.xxhash64(F.lit("wait"), "h", "nr"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("size")
    sample = keyed.filter(wait < shards * fine * per_range / total).select("h")
    keys = np.sort(np.array([r["h"] for r in sample.collect()], np.int64))
    if not len(keys):
        return np.array([], np.int64), np.array([], np.int64)
    at = np.unique((np.arange(1, shards * fine) * len(keys)) // (shards * fine))
    return np.unique(keys[at], return_counts=True)


def shard(
    docs: DataFrame, shards: int = 16, *, fine: int | None = None, per_range: int = PER_RANGE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns named in ``carry`` of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = cut(  # numbered rows are written once, so that numbers stay
        docs.select(
            F.monotonically_increasing_id().alias("nr"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            *carry,
        )
    )
    fine = fine or max(FINE, min(MOST_FINE, keyed.count() // (shards * RANGE_ROWS)))
    cuts, times = splitters(keyed, shards, fine, per_range)
    whole = WHOLE * max(1, fine // FINE)
    parts = np.where(times > whole, 4 * times, 1)  # an overfull range is cut finer than its quantiles

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(3).to_numpy(zero_copy_only=False)
            side = np.searchsorted(cuts, h, side="right")
            own = np.maximum(side - 1, 0)
            hot = (side > 0) & (cuts[own] == h) & (parts[own] > 1) if len(cuts) else np.zeros(len(h), bool)
            sub = batch.column(4).to_numpy(zero_copy_only=False)
            sub = np.where(hot, sub % np.where(hot, parts[own], 1), 0) if len(cuts) else sub * 0
            # an overfull hash comes before the other keys behind its splitter
            rng = np.where(hot, 2 * side, 2 * side + 1)
            rest = [batch.column(i) for i in range(6, batch.num_columns)]
            cols = [*(batch.column(i) for i in (0, 1, 2, 3, 5)), pa.array(rng.astype(np.int64)), pa.array(sub.astype(np.int64)), *rest]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "size", "text_crc32", "h", "nr", "rng", "sub", *carry])

    row_hash = F.pmod(F.xxhash64("doc_id", "nr"), F.lit(1 << 30)).alias("row_hash")
    ranged = over_batches(
        keyed.select("doc_id", "size", "text_crc32", "h", row_hash, "nr", *carry),
        ranges,
        with_fields("doc_id long, size long, text_crc32 long, h long, nr long, rng long, sub long", keyed, carry, ""),
    )
    ranged = cut(ranged)
    per = ranged.groupBy("rng", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    upto = W.orderBy("rng", "sub").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("run", F.sum("bytes").over(upto)).withColumn("all", F.sum("bytes").over(W.partitionBy()))
    middle = (F.col("run") - F.col("bytes") / 2.0) / F.col("all")
    per = per.withColumn("shard", F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int"))
    before = W.partitionBy("shard").orderBy("rng", "sub").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("rng", "sub", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_slot"))
    within = W.partitionBy("rng", "sub").orderBy("h", "doc_id", "nr")
    out = ranged.withColumn("place", F.row_number().over(within) - 1).join(per, ["rng", "sub"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **how) -> None:
    """Write ``docs`` under ``path``, a folder for each shard (``_shard=``), in the order of slots within a file.

    Rows are carried through ``shard``; columns of ``docs`` keep their names, whatever they are, in a struct ``row`` if one of them is ``_shard``.
    """
    placed = shard(docs.select("doc_id", "text", F.struct("*").alias("row")), shards, carry=("row",), **how)
    clash = "_shard" in docs.columns
    files = max(1, docs.sparkSession.sparkContext.defaultParallelism) * 4
    ordered = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*(["row"] if clash else ["row.*"]), F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)

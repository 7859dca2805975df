"""Lookups: inspect, duplicate acknowledgments, tickets, differential and crash checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import kernels as K
from tidewheel.schema import QueueConfig


def inspect(objects: DataFrame, job_id: str, spark: SparkSession, config: QueueConfig) -> DataFrame:
    """All states of one job; the shard is computed here, so that the scan prunes to it."""
    row = spark.range(1).select(K.shard(F.lit(config.queue_id), F.lit(job_id), config.shard_count).alias("s")).first()
    return objects.filter((F.col("shard") == row["s"]) & (F.col("job_id") == job_id))


def inspect_many(objects: DataFrame, ids: DataFrame, config: QueueConfig) -> DataFrame:
    """All states of every job named in ``ids`` (job_id), found or not: a join on shard and id, so that buckets on the shard prune."""
    asked = ids.select("job_id").distinct().withColumn("shard", K.shard(F.lit(config.queue_id), F.col("job_id"), config.shard_count))
    return asked.join(objects, ["shard", "job_id"], "left")


def find_quarantined(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files in the quarantine with these quarantine ids."""
    return files.filter(F.col("kind") == "quarantine").join(ids.select("quarantine_id").distinct(), "quarantine_id", "left_semi")


def duplicate_ack(acks: DataFrame, receipts: DataFrame, floor_ns: int, config: QueueConfig) -> DataFrame:
    """already_acked where a receipt of the same identity lies in the probed buckets, else lease_lost."""
    now = floor_ns // config.terminal_bucket_width_ns
    back = -(-config.receipt_retention_ns // config.terminal_bucket_width_ns) + 2
    probed = receipts.filter(F.col("bucket").between(now - back, now)).select("job_id", "attempt", "token").distinct().withColumn("_found", F.lit(True))
    out = acks.join(probed, ["job_id", "attempt", "token"], "left")
    return out.withColumn("outcome", F.when(F.col("_found"), "already_acked").otherwise("lease_lost")).drop("_found")


def resolve(tickets: DataFrame, objects: DataFrame) -> DataFrame:
    """Which of source and destination is there: tickets have source, destination paths and the identity they expect.

    Conflict (an object of another identity at a path) goes before all else.
    """
    at = objects.select(F.col("relative_path").alias("_p"), F.col("job_id").alias("_j"), F.col("generation").alias("_g"))
    out = tickets
    for side, generation in (("source", F.col("generation")), ("destination", F.col("generation") + 1)):
        seen = at.select(F.col("_p").alias(side), F.col("_j").alias(f"_{side}_j"), F.col("_g").alias(f"_{side}_g"))
        out = out.join(seen, side, "left")
        same = (F.col(f"_{side}_j") == F.col("job_id")) & (F.col(f"_{side}_g") == generation)
        out = out.withColumn(f"{side}_state", F.when(F.col(f"_{side}_j").isNull(), "absent").when(same, "match").otherwise("conflict"))
        out = out.drop(f"_{side}_j", f"_{side}_g")
    s, d = F.col("source_state"), F.col("destination_state")
    outcome = (
        F.when((s == "conflict") | (d == "conflict"), "conflicting").when((s == "match") & (d == "match"), "both").when(s == "match", "source").when(d == "match", "destination").otherwise("neither")
    )
    return out.withColumn("outcome", outcome)


def differential(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of (job_id, state, generation, attempt) that differ between an oracle and what is there."""
    e = expected.select("job_id", *[F.col(c).alias(f"expected_{c}") for c in ("state", "generation", "attempt")])
    a = actual.select("job_id", *[F.col(c).alias(f"actual_{c}") for c in ("state", "generation", "attempt")])
    j = e.join(a, "job_id", "full")
    what = (
        F.when(F.col("actual_state").isNull(), "missing")
        .when(F.col("expected_state").isNull(), "unexpected")
        .when(F.col("expected_state") != F.col("actual_state"), "state")
        .when(F.col("expected_generation") != F.col("actual_generation"), "generation")
        .when(F.col("expected_attempt") != F.col("actual_attempt"), "attempt")
    )
    return j.withColumn("mismatch", what).filter("mismatch is not null")


def crash_gates(oplog: DataFrame, snapshot: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """job_id, gate: committed jobs that are gone (lost), acknowledged jobs that are still active (acked_active)
    or were ``delivered`` to a probe after the crash (acked_delivered).  Jobs without a log line are no violation.
    """
    committed = oplog.filter("op = 'enqueue'").select("job_id").distinct()
    acked = oplog.filter("op = 'ack'").select("job_id").distinct()
    lost = committed.join(snapshot, "job_id", "left_anti").select("job_id", F.lit("lost").alias("gate"))
    active = snapshot.filter(F.col("state").isin("ready", "leased", "delayed"))
    found = lost.union(active.join(acked, "job_id", "left_semi").select("job_id", F.lit("acked_active").alias("gate")))
    if delivered is None:
        return found
    return found.union(delivered.select("job_id").distinct().join(acked, "job_id", "left_semi").select("job_id", F.lit("acked_delivered").alias("gate")))

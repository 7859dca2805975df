"""State transitions as projections: every function takes rows of the source state and gives rows of the next.

The next identity follows the protocol: generation + 1, attempt + 1 for a claim.  Clocks are arguments.
Claims are unique because one query makes all of them, shard by shard; two drivers at once would break that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import kernels as K
from tidewheel.schema import PROTOCOL, QueueConfig

ATTEMPTS_EXHAUSTED = 4


def route_enqueued(jobs: DataFrame, floor_ns: int, config: QueueConfig) -> DataFrame:
    """hidden -> ready, or delayed if not_before is above the floor; generation and attempt 0."""
    later = F.col("not_before_ns") > floor_ns
    bucket = K.bucket_ceil(F.col("not_before_ns"), F.lit(config.delayed_bucket_width_ns)).cast("long")
    return jobs.withColumns(
        {
            "state": F.when(later, "delayed").otherwise("ready"),
            "op": F.when(later, "enqueue_delayed").otherwise("enqueue_immediate"),
            "generation": F.lit(0).cast("long"),
            "attempt": F.lit(0).cast("long"),
            "bucket": F.when(later, bucket),
        }
    )


def promotable(delayed: DataFrame, floor_ns: int, config: QueueConfig) -> DataFrame:
    """Delayed rows whose bucket has come: a predicate on the bucket alone, which prunes partitions."""
    return delayed.filter(F.col("bucket") <= floor_ns // config.delayed_bucket_width_ns)


def promote(delayed: DataFrame, floor_ns: int, config: QueueConfig) -> DataFrame:
    return promotable(delayed, floor_ns, config).withColumns({"state": F.lit("ready"), "generation": F.col("generation") + 1, "bucket": F.lit(None).cast("long")})


def claimable(rows: DataFrame | None = None) -> Column:
    """Attempts are left; and for rows of a tree (``sources.with_names``) also a name of a ready object, its tag and its shard."""
    left = F.col("attempt") < F.col("maximum_attempts")
    if rows is not None and "tag_ok" in rows.columns:
        left = F.coalesce(left & (F.col("kind") == "ready") & F.col("tag_ok") & F.col("shard_ok"), F.lit(False))
    return left


def claim(ready: DataFrame, per_shard: int, now_ns: int, boottime_ns: int, duration_ns: int, boot_id: str, config: QueueConfig) -> DataFrame:
    """ready -> leased: the first ``per_shard`` claimable rows of every shard, by age and id.

    The rank's limit is applied before the shuffle too, so each task sends ``per_shard`` rows a shard at most.
    Tokens are digests of identity and generation, so that a recomputed task makes the same ones.
    """
    rank = F.row_number().over(W.partitionBy("shard").orderBy("created_ns", "job_id"))
    won = ready.filter(claimable()).withColumn("rank", rank).filter(F.col("rank") <= per_shard)
    return won.withColumns(
        {
            "state": F.lit("leased"),
            "generation": F.col("generation") + 1,
            "attempt": F.col("attempt") + 1,
            "token": F.md5(F.concat_ws(":", "job_id", (F.col("generation") + 1).cast("string"))),
            "boot_id": F.lit(boot_id),
            "boottime_deadline_ns": F.lit(boottime_ns + duration_ns),
            "wall_deadline_ns": F.lit(now_ns + duration_ns),
            "bucket": F.lit((boottime_ns + duration_ns) // config.lease_bucket_width_ns),
        }
    )


def bury_exhausted(ready: DataFrame, floor_ns: int, config: QueueConfig) -> DataFrame:
    """ready -> dead, for rows without attempts left."""
    return to_dead(ready.filter(~claimable()), F.lit(ATTEMPTS_EXHAUSTED), floor_ns, config)


def to_dead(rows: DataFrame, reason: Column, floor_ns: int, config: QueueConfig) -> DataFrame:
    return rows.withColumns(
        {
            "state": F.lit("dead"),
            "reason": reason,
            "generation": F.col("generation") + 1,
            "bucket": F.lit(floor_ns // config.terminal_bucket_width_ns),
        }
    )


def held(leases: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (job_id, generation, token, ...) joined to the lease that they name; outcome lease_lost where there is none."""
    key = ["job_id", "generation", "token"]
    found = requests.join(leases.withColumn("_held", F.lit(True)), key, "left")
    return found.withColumn("outcome", F.when(F.col("_held"), "committed").otherwise("lease_lost")).drop("_held")


def renew(leased: DataFrame, now_ns: Column, duration_ns: int, config: QueueConfig) -> DataFrame:
    deadline = now_ns + duration_ns
    return leased.withColumns(
        {"generation": F.col("generation") + 1, "wall_deadline_ns": deadline, "bucket": K.bucket_floor(deadline, F.lit(config.lease_bucket_width_ns)).cast("long")}
    )


def acknowledge(leased: DataFrame, floor_ns: Column, config: QueueConfig) -> DataFrame:
    """leased -> receipt.  Rows that have payload and payload_digest get a receipt only if the payload still has that digest."""
    if "payload" in leased.columns and "payload_digest" in leased.columns:
        leased = leased.filter(K.payload_digest(F.col("payload")) == F.col("payload_digest"))
    return leased.withColumns(
        {"state": F.lit("receipt"), "generation": F.col("generation") + 1, "bucket": K.bucket_floor(floor_ns, F.lit(config.terminal_bucket_width_ns)).cast("long")}
    )


def retry(leased: DataFrame, floor_ns: Column, not_before_ns: Column, config: QueueConfig) -> DataFrame:
    """leased -> ready at once, -> delayed for a time above the floor, -> dead without attempts left; says so in effective_op."""
    spent = F.col("attempt") >= F.col("maximum_attempts")
    later = not_before_ns > floor_ns
    return leased.withColumns(
        {
            "effective_op": F.when(spent, "bury").when(later, "retry_later").otherwise("retry_now"),
            "state": F.when(spent, "dead").when(later, "delayed").otherwise("ready"),
            "reason": F.when(spent, F.lit(ATTEMPTS_EXHAUSTED)),
            "generation": F.col("generation") + 1,
            "bucket": F.when(spent, K.bucket_floor(floor_ns, F.lit(config.terminal_bucket_width_ns)).cast("long")).when(
                later, K.bucket_ceil(not_before_ns, F.lit(config.delayed_bucket_width_ns)).cast("long")
            ),
        }
    )


def expired(now_ns: int, boot_id: str, config: QueueConfig | None = None) -> Column:
    """A lease of another boot, or whose deadline has passed.  With ``config``, also by the lease's bucket, which prunes partitions."""
    passed = F.col("deadline_ns") <= now_ns
    if config is not None:
        passed = (F.col("bucket") <= now_ns // config.lease_bucket_width_ns) & passed
    return (F.col("boot_id") != boot_id) | passed


def reap(leased: DataFrame, now_ns: int, boot_id: str, config: QueueConfig | None = None) -> DataFrame:
    """Expired leases -> ready if attempts remain, else dead."""
    left = F.col("attempt") < F.col("maximum_attempts")
    return leased.filter(expired(now_ns, boot_id, config)).withColumns(
        {
            "op": F.when(left, "reap_expired_to_ready").otherwise("reap_expired_to_dead"),
            "state": F.when(left, "ready").otherwise("dead"),
            "reason": F.when(~left, F.lit(ATTEMPTS_EXHAUSTED)),
            "generation": F.col("generation") + 1,
        }
    )


def retention_over(floor_ns: int, config: QueueConfig) -> Column:
    """A receipt's bucket has ended longer ago than the retention; false where the sum overflows."""
    end = K.checked_add(K.bucket_end(F.col("bucket"), F.lit(config.terminal_bucket_width_ns)), K.u64(config.receipt_retention_ns))
    return F.coalesce(end <= floor_ns, F.lit(False))


def compact(receipts: DataFrame) -> DataFrame:
    """Full receipts whose payload is verified keep 128 bytes."""
    return receipts.filter((F.col("receipt_kind") == "full") & F.col("verified")).withColumns({"receipt_kind": F.lit("compact"), "size": F.lit(128).cast("long")})


def temp_deletable(boottime_ns: int, boot_id: str, config: QueueConfig) -> Column:
    return (F.col("boot_id") != boot_id) | (F.lit(boottime_ns) - F.col("created_boottime_ns") > config.temporary_ttl_ns)


def quarantine(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.withColumns({"state": F.lit("quarantine"), "reason": reason, "quarantine_id": F.md5(F.concat_ws(":", F.lit("quarantine"), "job_id"))})


def requeue(rows: DataFrame) -> DataFrame:
    """A new identity with the old one as provenance (administrative; specified, not part of the protocol's edges)."""
    return rows.withColumns(
        {
            "provenance": F.col("job_id"),
            "job_id": F.md5(F.concat_ws(":", F.lit("requeue"), "job_id")),
            "state": F.lit("ready"),
            "generation": F.lit(0).cast("long"),
            "attempt": F.lit(0).cast("long"),
            "reason": F.lit(None).cast("int"),
        }
    )


def remove(objects: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """The next snapshot, without the named rows."""
    return objects.join(ids.select(key).distinct(), key, "left_anti")


def apply_changes(objects: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot: changed rows replace those of the same job."""
    kept = objects.join(changed.select("job_id").distinct(), "job_id", "left_anti")
    return kept.unionByName(changed.select(*[c for c in objects.columns if c in changed.columns]), allowMissingColumns=True)


def legal(op: Column, source: Column) -> Column:
    """Whether the protocol has an edge of this operation from this state."""
    c = F.lit(False)
    for name, s, *_ in PROTOCOL:
        ok = source.isin("ready", "leased", "delayed", "receipt", "dead") if s == "active" else source == s
        c = F.when(op == name, ok).otherwise(c)
    return F.coalesce(c, F.lit(False))


#: Entries of a job that one task puts in order.
CHUNK = 4096


def with_source(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """from_state by the entry before (hidden for the first), whether it was legal or not, and ``legal``.

    A job's log is cut into chunks of generations, so that a hot job is many groups; a chunk's first entry takes the last state of the chunk before.
    """
    log = log.withColumn("_chunk", F.floor(F.col("generation") / chunk))
    ends = log.groupBy("job_id", "_chunk").agg(F.max_by("to_state", "generation").alias("_end"))
    ends = ends.select("job_id", "_chunk", F.lag("_end").over(W.partitionBy("job_id").orderBy("_chunk")).alias("_before"))
    before = F.lag("to_state").over(W.partitionBy("job_id", "_chunk").orderBy("generation"))
    log = log.withColumn("_own", before).join(ends, ["job_id", "_chunk"])
    log = log.withColumn("from_state", F.coalesce("_own", "_before", F.lit("hidden")))
    return log.withColumn("legal", legal(F.col("op"), F.col("from_state"))).drop("_chunk", "_own", "_before")


#: States that a fold of a log can be in.
_FOLD = ("hidden", "ready", "leased", "delayed", "receipt", "dead", "quarantine")


def accepted(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Fold of each job's log that only follows legal edges: job_id, state, accepted, rejected.

    A stretch of the log is a function from the state before it to the state after it, and functions compose.  So chunks of generations
    are first folded from every state at once, then each chunk's true state before it is looked up, and then entries are counted from there.
    No task holds more than a chunk's entries, and a job's chunks.
    """
    entry = F.struct("generation", "op", "to_state")
    logs = log.groupBy("job_id", F.floor(F.col("generation") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("log"))

    def move(state: Column, x: Column) -> Column:
        return F.when(legal(x["op"], state), x["to_state"]).otherwise(state)

    after = F.struct(*[F.aggregate("log", F.lit(s), move).alias(s) for s in _FOLD])
    last = F.max("chunk").over(W.partitionBy("job_id"))
    many = logs.select("job_id", "chunk", after.alias("after"), last.alias("last")).filter("last > 0")
    chunks = many.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "after"))).alias("chunks"))

    def next_start(acc: Column, c: Column) -> Column:
        end = F.lit("hidden")
        for s in _FOLD:
            end = F.when(acc["state"] == s, c["after"][s]).otherwise(end)
        begun = F.concat(acc["starts"], F.array(F.struct(c["chunk"].alias("chunk"), acc["state"].alias("state"))))
        return F.struct(end.alias("state"), begun.alias("starts"))

    none = F.struct(F.lit("hidden").alias("state"), F.array().cast("array<struct<chunk:bigint,state:string>>").alias("starts"))
    starts = chunks.select("job_id", F.explode(F.aggregate("chunks", none, next_start)["starts"]).alias("s")).select("job_id", "s.chunk", F.col("s.state").alias("start"))
    logs = logs.join(starts, ["job_id", "chunk"], "left").withColumn("start", F.coalesce("start", F.lit("hidden")))

    def step(acc: Column, x: Column) -> Column:
        ok = legal(x["op"], acc["state"])
        return F.struct(F.when(ok, x["to_state"]).otherwise(acc["state"]).alias("state"), (acc["n"] + ok.cast("long")).alias("n"))

    done = F.aggregate("log", F.struct(F.col("start").alias("state"), F.lit(0).cast("long").alias("n")), step)
    counted = logs.select("job_id", "chunk", done.alias("done"), F.size("log").cast("long").alias("entries"))
    return counted.groupBy("job_id").agg(
        F.max_by("done.state", "chunk").alias("state"), F.sum("done.n").alias("accepted"), (F.sum("entries") - F.sum("done.n")).alias("rejected")
    )


def attempt_history(log: DataFrame) -> DataFrame:
    """Each log entry with the entry before and after it and the time since (an extension): job_id, generation, op, previous_op, next_op, gap_ns."""
    by = W.partitionBy("job_id").orderBy("generation")
    return log.select("job_id", "generation", "op", F.lag("op").over(by).alias("previous_op"), F.lead("op").over(by).alias("next_op"), (F.col("wall_ns") - F.lag("wall_ns").over(by)).alias("gap_ns"))


def retry_with_policy(leased: DataFrame, floor_ns: Column, base_ms: int, cap_ms: int, queue_id: str, config: QueueConfig, jitter: bool = True, max_delay_ms: int | None = None) -> DataFrame:
    """``retry`` at the deadline that a policy gives: delay by attempt, capped, with or without jitter; a deadline beyond the clock's range is null and retries at once."""
    K.check_policy(base_ms, cap_ms, max_delay_ms)
    cap = K.effective_cap(F.lit(cap_ms), None if max_delay_ms is None else F.lit(max_delay_ms))
    attempt = F.col("attempt")
    delay = K.retry_delay(F.lit(queue_id), F.col("job_id"), F.lit(base_ms), cap, attempt) if jitter else K.retry_ceiling(F.lit(base_ms), cap, attempt)
    at = K.retry_deadline(floor_ns, K.checked_mul(delay, F.lit(1_000_000))).cast("long")
    timed = leased.withColumns({"delay_ms": delay.cast("long"), "not_before_ns": at})
    return retry(timed, floor_ns, F.coalesce(F.col("not_before_ns"), floor_ns), config)


def durable(outcomes: DataFrame, synced_to: int) -> DataFrame:
    """Outcomes of deferred commits: ``committed`` up to the last sync's sequence number, ``deferred`` behind it."""
    return outcomes.withColumn("durability", F.when(F.col("outcome") != "committed", F.col("outcome")).when(F.col("seq") <= synced_to, "committed").otherwise("deferred"))


def poisoned(outcomes: DataFrame, handle: str = "handle", seq: str = "seq") -> DataFrame:
    """``poisoned``: whether a handle had an indeterminate outcome before this operation; its later operations are refused (outcome refused)."""
    first = outcomes.filter("outcome = 'unknown'").groupBy(handle).agg(F.min(seq).alias("_first"))
    rows = outcomes.join(first, handle, "left")
    rows = rows.withColumn("poisoned", F.coalesce(F.col(seq) > F.col("_first"), F.lit(False)))
    return rows.withColumn("outcome", F.when(F.col("poisoned"), "refused").otherwise(F.col("outcome"))).drop("_first")


def running_max(log: DataFrame, value: str, seq: str, chunk: int = 65_536) -> DataFrame:
    """``floor``: the largest value up to each row in the order of ``seq``, chunk by chunk, so that no task sorts the log."""
    log = log.withColumn("_chunk", F.floor(F.col(seq) / chunk))
    tops = log.groupBy("_chunk").agg(F.max(value).alias("_top"))
    tops = tops.select("_chunk", F.max("_top").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = F.max(value).over(W.partitionBy("_chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    out = log.withColumn("_own", own).join(tops, "_chunk")
    return out.withColumn("floor", F.greatest("_own", "_before")).drop("_chunk", "_own", "_before")

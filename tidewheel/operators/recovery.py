"""Recovery: a ring of five phases over a snapshot, in one pass or in steps with a budget and a kept cursor.

The phases are, in order: reap, promote, temp, compact, delete.  What each does to a row follows from the row alone, so a
whole pass is one projection of the snapshot (``plan``), one aggregation of it for the report, and no join.

In steps, a cursor is the (bucket, shard, job_id) of the last row done; the next step takes the rows above it.  Rows are taken in
that order, so that steps of any budget together do what one unlimited pass does, and a second pass changes nothing.
Phase and cursor are kept in a folder that all executors share, one row a step, so that a new session goes on where the last one ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import kernels as K
from tidewheel.operators import transitions as X
from tidewheel.schema import QueueConfig

ORDER = ("bucket", "shard", "job_id")
PHASES = ("reap", "promote", "temp", "compact", "delete")
COUNTERS = ("operations_attempted", "leases_reaped", "leases_to_dead", "delayed_promoted", "temp_files_deleted", "receipts_compacted", "receipts_expired", "buckets_removed", "shards_removed")


@dataclass
class Cursor:
    bucket: int = -1
    shard: int = -1
    job_id: str = ""


@dataclass
class Position:
    """Where the ring stands: the phase to go on with, and the row behind which it does."""

    step: int = 0
    phase: str = PHASES[0]
    cursor: Cursor | None = None


def after(cursor: Cursor | None):
    """Rows above the cursor."""
    if cursor is None:
        return F.lit(True)
    low = F.struct(F.lit(cursor.bucket).cast("long").alias("bucket"), F.lit(cursor.shard).alias("shard"), F.lit(cursor.job_id).alias("job_id"))
    row = F.struct(F.coalesce(F.col("bucket"), F.lit(-1)).cast("long").alias("bucket"), F.col("shard").alias("shard"), F.col("job_id").alias("job_id"))
    return row > low


def take(rows: DataFrame, cursor: Cursor | None, budget: int) -> DataFrame:
    """The next ``budget`` rows in order: a top-k, not a sort of all rows."""
    return rows.filter(after(cursor)).orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]).limit(budget)


def step(rows: DataFrame, cursor: Cursor | None, budget: int) -> tuple[DataFrame, Cursor | None]:
    """(rows to do now, the cursor behind them; None when the phase is over)."""
    part = take(rows, cursor, budget)
    last = part.agg(F.max(F.struct(F.coalesce("bucket", F.lit(-1)).cast("long").alias("bucket"), "shard", "job_id")).alias("m"), F.count("*").alias("n")).first()
    done = last["n"] < budget
    return part, None if done else Cursor(*last["m"])


# -- the whole ring


def plan(objects: DataFrame, now_ns: int, boot_id: str, config: QueueConfig, boottime_ns: int = 0) -> DataFrame:
    """``objects`` with actions, an array of (phase, state after it), in the order of the ring; empty for a row that stays.

    States: leased, delayed, ready, dead, receipt, temp.  A lease of another boot, or whose deadline and bucket have passed, is
    reaped; a lease's own bucket predicate prunes.  Columns that a table lacks count as null.
    """
    have = lambda c, kind="string": F.col(c) if c in objects.columns else F.lit(None).cast(kind)
    state = F.col("state")
    left = F.col("attempt") < F.col("maximum_attempts")
    over = (have("boot_id") != boot_id) | (have("deadline_ns", "long") <= now_ns)
    due = F.col("bucket") <= now_ns // config.delayed_bucket_width_ns
    old_temp = (have("boot_id") != boot_id) | (F.lit(boottime_ns) - have("created_boottime_ns", "long") > config.temporary_ttl_ns)
    compactable = (have("receipt_kind") == "full") & have("verified", "boolean")
    expired = X.retention_over(now_ns, config)
    one = lambda when, phase, to: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(phase).alias("phase"), to.alias("state")))
    actions = F.array(
        one((state == "leased") & over, "reap", F.when(left, "ready").otherwise("dead")),
        one((state == "delayed") & due, "promote", F.lit("ready")),
        one((state == "temp") & old_temp, "temp", F.lit("removed")),
        one((state == "receipt") & compactable, "compact", F.lit("receipt")),
        one((state == "receipt") & expired, "delete", F.lit("removed")),
    )
    return K.once(objects, "actions", F.array_compact(actions))


def apply(planned: DataFrame, now_ns: int, config: QueueConfig) -> DataFrame:
    """The next snapshot of ``plan``'s rows: removed rows are gone, moved ones have the next identity."""
    last = F.try_element_at(F.col("actions"), F.lit(-1))["state"]
    moved = F.exists("actions", lambda a: a["phase"].isin("reap", "promote"))
    rows = planned.filter(F.coalesce(last != "removed", F.lit(True)))
    dead = moved & (last == "dead")
    changes = {
        "generation": F.when(moved, F.col("generation") + 1).otherwise(F.col("generation")),
        "bucket": F.when(dead, F.lit(now_ns // config.terminal_bucket_width_ns)).when(~moved, F.col("bucket")),
        "state": F.coalesce(last, F.col("state")),
    }
    if "reason" in planned.columns:
        changes["reason"] = F.when(dead, F.lit(X.ATTEMPTS_EXHAUSTED)).otherwise(F.col("reason"))
    if "receipt_kind" in planned.columns:
        changes["receipt_kind"] = F.when(F.exists("actions", lambda a: a["phase"] == "compact"), "compact").otherwise(F.col("receipt_kind"))
    return rows.withColumns(changes).drop("actions")


def by_phase(planned: DataFrame) -> DataFrame:
    """phase, state (after it; before it for what is removed), n: one scan and one aggregation."""
    state = F.when(F.col("a.state") == "removed", F.col("was")).otherwise(F.col("a.state")).alias("state")
    return planned.select(F.explode("actions").alias("a"), F.col("state").alias("was")).groupBy("a.phase", state).agg(F.count("*").alias("n"))


def counters(planned: DataFrame) -> DataFrame:
    """One row: the counters of a pass.  Buckets and shards are removed where no receipt is left in them."""
    done = lambda phase, state=None: F.coalesce(
        F.sum(F.size(F.filter("actions", lambda a: (a["phase"] == phase) & (F.lit(True) if state is None else a["state"] == state)))), F.lit(0)
    ).cast("long")
    receipts = planned.filter("state = 'receipt'").withColumn("gone", F.exists("actions", lambda a: a["phase"] == "delete").cast("int"))
    shards = receipts.groupBy("bucket", "shard").agg(F.min("gone").alias("gone"))
    empty = shards.groupBy("bucket").agg(F.min("gone").alias("bucket_gone"), F.sum("gone").alias("shards_gone"))
    empty = empty.agg(F.coalesce(F.sum("bucket_gone"), F.lit(0)).cast("long").alias("buckets_removed"), F.coalesce(F.sum("shards_gone"), F.lit(0)).cast("long").alias("shards_removed"))
    done_ = planned.agg(
        F.coalesce(F.sum(F.size("actions")), F.lit(0)).cast("long").alias("operations_attempted"),
        done("reap", "ready").alias("leases_reaped"),
        done("reap", "dead").alias("leases_to_dead"),
        done("promote").alias("delayed_promoted"),
        done("temp").alias("temp_files_deleted"),
        done("compact").alias("receipts_compacted"),
        done("delete").alias("receipts_expired"),
    )
    zero = {c: F.lit(0).cast("long") for c in COUNTERS}
    both = done_.withColumns({c: zero[c] for c in COUNTERS if c not in done_.columns}).unionByName(empty.withColumns({c: zero[c] for c in COUNTERS if c not in empty.columns}))
    return both.agg(*[F.sum(c).alias(c) for c in COUNTERS])


def problems(planned: DataFrame, config: QueueConfig) -> DataFrame:
    """relative identity and problem of rows that recovery must not act on: quarantine (a lease or delayed row without a bucket,
    attempts above the maximum) and error (unreadable).  They go into the report's lists as rows, not as one array.
    """
    bad = F.when(F.col("state").isin("leased", "delayed") & F.col("bucket").isNull(), "quarantine").when(F.col("attempt") > F.col("maximum_attempts"), "quarantine")
    if "unreadable" in planned.columns:
        bad = F.when(F.col("unreadable"), "error").otherwise(bad)
    found = planned.select("job_id", "state", bad.alias("problem")).filter("problem is not null")
    return found.withColumn("quarantine_id", F.when(F.col("problem") == "quarantine", F.md5(F.concat_ws(":", F.lit("quarantine"), "job_id"))))


def recover(objects: DataFrame, now_ns: int, boot_id: str, config: QueueConfig, boottime_ns: int = 0) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, report by phase): one whole pass of the ring."""
    planned = plan(objects, now_ns, boot_id, config, boottime_ns)
    return apply(planned, now_ns, config), by_phase(planned)


# -- steps


def load_position(spark: SparkSession, folder: str) -> Position:
    """The position that the last step in ``folder`` has left; the start for a new folder."""
    try:
        rows = spark.read.schema("step long, position string").parquet(f"{folder}/steps")
        last = rows.agg(F.max_by("position", "step").alias("p")).first()["p"]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last is None:
        return Position()
    p = json.loads(last)
    return Position(p["step"], p["phase"], Cursor(**p["cursor"]) if p["cursor"] else None)


def save_position(spark: SparkSession, folder: str, position: Position) -> None:
    """One row a step; a step that is repeated writes the same row once more."""
    row = spark.createDataFrame([(position.step, json.dumps(asdict(position)))], "step long, position string")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/steps")


@dataclass
class Step:
    """What a step does: rows (of ``plan``, with their phase), and the position after it."""

    rows: DataFrame
    position: Position
    exhausted: bool
    done: dict[str, int] = field(default_factory=dict)


def next_step(objects: DataFrame, folder: str, budget: int, now_ns: int, boot_id: str, config: QueueConfig, boottime_ns: int = 0) -> Step:
    """The next ``budget`` operations of the ring, from the kept position on; phases follow each other until the budget is spent or the ring is round.

    The position is saved by ``commit`` after the rows have taken effect, so that a step that is lost is done again.
    """
    spark = objects.sparkSession
    at = load_position(spark, folder)
    planned = plan(objects, now_ns, boot_id, config, boottime_ns)
    out, cursor, left, done = None, at.cursor, budget, {}
    for phase in PHASES[PHASES.index(at.phase) :]:
        mine = planned.filter(F.array_contains(F.col("actions")["phase"], phase))
        part, cursor = step(mine, cursor, left)
        done[phase] = part.count()
        left -= done[phase]
        part = part.withColumn("phase", F.lit(phase))
        out = part if out is None else out.unionByName(part)
        if cursor is not None or left <= 0:
            position = Position(at.step + 1, phase, cursor)
            if cursor is None:
                position.phase = PHASES[(PHASES.index(phase) + 1) % len(PHASES)]
            return Step(out, position, True, done)
    return Step(out, Position(at.step + 1), False, done)


def commit(done: Step, folder: str) -> None:
    save_position(done.rows.sparkSession, folder, done.position)


def watch(read: Callable[[], DataFrame], act: Callable[[DataFrame], None], folder: str, budget: int, clock: Callable[[], int], boot_id: str, config: QueueConfig, passes: int) -> list[dict[str, int]]:
    """Recovery again and again: each pass reads the objects anew, does a step and keeps its position; operations by phase for each."""
    seen = []
    for _ in range(passes):
        now = next_step(read(), folder, budget, clock(), boot_id, config)
        act(now.rows)
        commit(now, folder)
        seen.append(now.done)
    return seen


def directories(files: DataFrame, max_entries: int, max_name_bytes: int) -> DataFrame:
    """directory, entries, name_bytes, bounded for every directory of a listing; unbounded ones are skipped by a scan and counted."""
    name = F.regexp_extract("relative_path", "([^/]*)$", 1)
    folder = F.regexp_replace("relative_path", "/[^/]*$", "")
    per = files.groupBy(folder.alias("directory")).agg(F.count("*").alias("entries"), F.sum(F.octet_length(name)).alias("name_bytes"))
    return per.withColumn("bounded", (F.col("entries") <= max_entries) & (F.col("name_bytes") <= max_name_bytes))

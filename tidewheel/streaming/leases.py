"""Streaming: lease expiry with a keyed timer, idempotent acknowledgments, and the log fold in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.runtime import ship
from tidewheel.sources.tables import EVENT_OPS, job_key

OUT = "job_id string, outcome string, generation long, at_us long"
STATE = "state string, generation long, deadline_us long"


def raw_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream; the schema is fixed, never inferred from data.  Works for a file and for a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("basePath", sf_dir).parquet(f"{sf_dir}/events.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream of (job_id, op, ts, seq) with event time."""
    s = raw_events(spark, sf_dir, files_per_trigger)
    op = F.lit(None).cast("string")
    for kind, (name, _) in EVENT_OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
    return s.select(job_key(F.col("user_id")).alias("job_id"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def lease_expiry(log: DataFrame, lease_seconds: int, delay: str = "0 seconds", bucket_us: int = 3_600_000_000, retention_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Outcome rows of a stream of (job_id, op, ts, seq).

    A legal claim starts a lease, a renewal extends it, an acknowledgment ends it; an operation on a lease that has
    run out, or isn't there, is ``lease_lost``.  A timer at the deadline says ``expired`` when the watermark passes it.
    A job's state is dropped when the retention after the end of its receipt's bucket is over, as the receipt itself would be.
    """

    def kept_until(us: int) -> int:
        return (us // bucket_us + 1) * bucket_us + retention_us

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now, generation, deadline = state.get if state.exists else ("hidden", 0, 0)
        if state.hasTimedOut:
            if now == "receipt":
                state.remove()
                return
            if now == "leased":
                generation += 1
                out.append((key[0], "expired", generation, deadline))
                now = "ready"
            state.update((now, generation, deadline))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for op, ts in zip(rows["op"], rows["ts"], strict=True):
                us = int(ts.value // 1000)
                if now == "leased" and us >= deadline:
                    generation += 1
                    out.append((key[0], "expired", generation, deadline))
                    now = "ready"
                if op == "enqueue_immediate" and now == "hidden":
                    now, generation = "ready", 0
                elif op == "claim" and now == "ready":
                    now, generation, deadline = "leased", generation + 1, us + lease_seconds * 1_000_000
                elif op == "renew" and now == "leased":
                    generation, deadline = generation + 1, us + lease_seconds * 1_000_000
                elif op == "retry_now" and now == "leased":
                    now, generation = "ready", generation + 1
                elif op == "acknowledge" and now == "leased":
                    now, generation, deadline = "receipt", generation + 1, kept_until(us)
                    out.append((key[0], "acknowledged", generation, us))
                elif op == "acknowledge" and now == "receipt":
                    out.append((key[0], "already_acked", generation, us))
                elif op in ("renew", "retry_now", "acknowledge"):
                    out.append((key[0], "lease_lost", generation, us))
            state.update((now, generation, deadline))
        if now in ("leased", "receipt"):
            state.setTimeoutTimestamp(max(deadline // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "outcome", "generation", "at_us"])

    ship(log.sparkSession)
    return log.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet in ``folder``, which all executors share; the sink is exactly-once.

    A later run with the same folder goes on behind what the earlier ones have read.
    """
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stored_watermark(spark: SparkSession, marks: str) -> DataFrame:
    """One row: the highest bucket stored in ``marks``; null before the first."""
    try:
        return spark.read.schema("bucket long").parquet(marks).agg(F.max("bucket").alias("bucket"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(None,)], "bucket long")


def wall_watermark(stream: DataFrame, log: str, marks: str, width_us: int) -> DataFrame:
    """Keep the highest bucket of a stream in ``marks``; returns the marks, one row a micro-batch.

    Each batch stores the greater of what is stored and its own, so the mark never falls, neither
    when clocks go back nor after a restart with another log; a batch that is repeated stores the same again.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        top = df.agg(F.max(F.floor(F.unix_micros("ts") / width_us)).alias("bucket"))
        best = top.union(stored_watermark(spark, marks)).agg(F.max("bucket").alias("bucket")).filter("bucket is not null")
        best.coalesce(1).write.mode("append").parquet(marks)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("bucket long").parquet(marks)


def work(claims: DataFrame, handler: Callable, column: str) -> DataFrame:
    """job_id, seq, op for a stream of claims: acknowledge where ``handler`` (a function of the column's value) gives true, else retry_now.

    The handler runs on executors, over Arrow batches, and must do no harm when a job is given to it again; one that raises is a failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ok(value) -> bool:
            try:
                return bool(handler(value))
            except Exception:
                return False

        for b in batches:
            yield pd.DataFrame({"job_id": b["job_id"], "seq": b["seq"], "op": ["acknowledge" if ok(v) else "retry_now" for v in b[column]]})

    ship(claims.sparkSession)
    return claims.select("job_id", "seq", column).mapInPandas(run, "job_id string, seq long, op string")


def watch(stream: DataFrame, act: Callable[[DataFrame, int], None], log: str, every: str | None = None):
    """Recovery, or any other act, on each micro-batch of a stream: once over what is there, or every so often (a started query) for a bounded wait."""
    w = stream.writeStream.foreachBatch(act).option("checkpointLocation", log)
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return q

"""Queue data as DataFrames: projections of the star-schema tables, and a reader and writer for queue trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.schema import QueueConfig

CONFIG = QueueConfig()
#: The clock of all queries: 1996-01-01 and 2024-02-01 UTC, and the boot that is current.
NOW_NS = 820_454_400 * 10**9
EVENTS_NOW_NS = 1_706_745_600 * 10**9
BOOT_ID = "0f" * 16
#: event type -> operation, state after it
EVENT_OPS = {
    "signup": ("enqueue_immediate", "ready"),
    "view": ("claim", "leased"),
    "click": ("renew", "leased"),
    "purchase": ("acknowledge", "receipt"),
    "error": ("retry_now", "ready"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long")
    return (days * 86400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def job_key(x: Column) -> Column:
    return F.md5(x.cast("string"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    o = o.withColumns({"job_id": job_key(F.col("o_orderkey")), "created_ns": micros(F.col("o_orderdate")) * 1000})
    return o.withColumns(
        {
            "maximum_attempts": 1 + F.col("o_orderkey") % 5,
            "not_before_ns": F.col("created_ns") + (F.col("o_orderkey") % 7) * 3_600_000_000_000,
            "shard": K.shard(F.lit(CONFIG.queue_id), F.col("job_id"), CONFIG.shard_count),
        }
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a delivery: its number in the job, outcome, lease deadline and token."""
    line = table(spark, sf_dir, "lineitem")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*line.columns))
    line = line.withColumn("attempt", number.cast("long")).select(
        F.col("l_orderkey").alias("o_orderkey"),
        "attempt",
        F.when(F.col("l_returnflag") == "A", "ack").when(F.col("l_returnflag") == "R", "retry").otherwise("expire").alias("outcome"),
        (micros(F.col("l_shipdate")) * 1000).alias("deadline_ns"),
        F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), number.cast("string"))).alias("token"),
        F.md5((F.col("l_suppkey") % 2).cast("string")).alias("boot_id"),
    )
    return line.join(jobs(spark, sf_dir).select("o_orderkey", "job_id", "created_ns", "maximum_attempts", "shard"), "o_orderkey")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition log: seq, op, job_id, to_state, generation, wall_ns."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    op, to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, state) in EVENT_OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
        to = F.when(F.col("event_type") == kind, state).otherwise(to)
    generation = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("event_id").alias("seq"), "user_id", job_key(F.col("user_id")).alias("job_id"), op.alias("op"), to.alias("to_state"),
        generation.cast("long").alias("generation"), (micros(F.col("ts")) * 1000).alias("wall_ns"),
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last transition of every job as job_id, op, state, generation, wall_ns, seq, from the events themselves: entries
    are only counted, so this is one partial aggregation and one shuffle on the key that it groups by.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"), (F.count("*") - 1).alias("generation"))
    op, to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, state) in EVENT_OPS.items():
        op = F.when(F.col("e.event_type") == kind, name).otherwise(op)
        to = F.when(F.col("e.event_type") == kind, state).otherwise(to)
    return last.select(
        job_key(F.col("user_id")).alias("job_id"), op.alias("op"), to.alias("state"), "generation", (micros(F.col("e.ts")) * 1000).alias("wall_ns"), F.col("e.event_id").alias("seq")
    )


def latest(log: DataFrame) -> DataFrame:
    """The last transition of every job: a partial aggregation, no window."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("op", "to_state", "generation", "wall_ns", "seq"), "generation").alias("last")).select("job_id", "last.*")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.select(
        "doc_id", job_key(F.col("doc_id")).alias("job_id"), F.col("text").cast("binary").alias("payload"), F.concat(F.lit("text/"), F.col("lang")).alias("content_type")
    )


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with the digest that was stored for them; documents of quality 0 have another's."""
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    p = payloads(spark, sf_dir).join(bad, "doc_id", "left")
    other = F.sha2(F.reverse(F.col("payload").cast("string")).cast("binary"), 256)
    return p.withColumn("stored_digest", F.when(F.col("bad"), other).otherwise(K.payload_digest(F.col("payload"))))


# -- queue trees


def read_tree(spark: SparkSession, root: str, config: QueueConfig = CONFIG, glob: str = "*") -> DataFrame:
    """One row a file: path parts, name fields, tag check, size, time and content.

    ``content`` is only read by queries that select it; the state comes from the name, never from the directory.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_extract("path", "/((?:ready|leased|delayed|receipts|dead|quarantine)/.*)$", 1)
    return with_names(raw.select(rel.alias("relative_path"), "modificationTime", "length", "content"), config)


def with_names(files: DataFrame, config: QueueConfig = CONFIG) -> DataFrame:
    files = files.withColumns(N.parse_path(F.col("relative_path")))
    files = N.with_parsed(files, "name", "bucket_hex", "shard_hex", config.queue_id, config.lease_bucket_width_ns)
    placed = K.hex_field(K.shard(F.lit(config.queue_id), F.col("job_id"), config.shard_count), 4) == F.col("shard_hex")
    return files.withColumns({"state": F.when(~F.col("kind").isin("temp"), F.col("kind")), "shard_ok": placed})


def payload_reads(files: DataFrame, reads: DataFrame) -> DataFrame:
    """Parts of payloads: rows (job_id, offset, size) of ``reads`` joined to stored objects, as job_id, offset, bytes.

    An object's payload is verified against its header once, before it is cut; unsound objects give no bytes.
    """
    from tidewheel.functions import binary as B

    sound = files.select("job_id", B.decode_job(F.col("content"), deep=True)["error"].isNull().alias("sound"), B.payload(F.col("content")).alias("payload")).filter("sound")
    j = reads.join(sound, "job_id")
    return j.select("job_id", "offset", F.substring(F.col("payload"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("bytes"))


def export(files: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(name, content) of dead objects (by job_id) or quarantined ones (by quarantine_id): raw bytes, to be written with ``write_tree``."""
    key = "quarantine_id" if kind == "quarantine" else "job_id"
    return files.filter(F.col("kind") == kind).join(ids.select(key).distinct(), key, "left_semi").select(key, F.col("name").alias("relative_path"), "content")


def publish(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with ``new`` entries appended; an entry whose (job_id, generation) is there already isn't overwritten and comes back as refused."""
    key = ["job_id", "generation"]
    fresh = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("seq"))).join(log.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return fresh.withColumn("refused", F.col("_there").isNotNull() | (F.col("_n") > 1)).drop("_n", "_there")


def write_tree(objects: DataFrame, root: str) -> None:
    """Write (relative_path, content) rows as files, each by a temporary name and a rename that doesn't overwrite.

    For fixtures and exports; ``root`` is a folder that all executors share.
    """

    def save(rows) -> None:
        import os
        import uuid

        for r in rows:
            to = os.path.join(root, r["relative_path"])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["content"])
            try:
                os.link(part, to)
            except FileExistsError:
                pass
            finally:
                os.unlink(part)

    objects.select("relative_path", "content").foreachPartition(save)

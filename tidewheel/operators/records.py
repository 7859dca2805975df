"""Files of any kind: what they are, whether they are sound, and the fields that a dump shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import kernels as K
from tidewheel.schema import MAGIC_FORMAT, MAGIC_JOB, QueueConfig


def type_of(data: Column) -> Column:
    """job, format or unknown, by length and magic."""
    magic = F.substring(data, 1, 8)
    job = (F.octet_length(data) >= 128) & (magic == F.lit(MAGIC_JOB))
    return F.when(job, "job").when((F.octet_length(data) == 160) & (magic == F.lit(MAGIC_FORMAT)), "format").otherwise("unknown")


def verify(files: DataFrame, deep: bool = False, column: str = "content") -> DataFrame:
    """``files`` with type, error (the first check that fails) and exit_code: 0, 3 for corruption, 1 for an unknown format."""
    data, kind = F.col(column), F.col("type")
    job, fmt = B.decode_job(data, deep)["error"], B.decode_format(data)["error"]
    error = F.when(kind == "job", job).when(kind == "format", fmt).otherwise("unknown_format")
    out = K.once(K.once(files, "type", type_of(data)), "error", error)
    return out.withColumn("exit_code", F.when(F.col("error").isNull(), 0).when(F.col("type") == "unknown", 1).otherwise(3))


def dump(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with type and the fields of its record; null where the type has no such field."""
    data, kind = F.col(column), F.col("type")
    job, fmt = B.fields(data, B.JOB), B.fields(data, B.FORMAT)
    out = K.once(files, "type", type_of(data))
    shown = {c: F.when(kind == "job", job[c]) for c in ("job_id", "payload_length", "extension_length", "maximum_attempts", "payload_digest", "envelope_digest")}
    shown |= {c: F.when(kind == "format", fmt[c]) for c in ("queue_id", "shard_count", "lease_bucket_width_ns", "delayed_bucket_width_ns", "terminal_bucket_width_ns", "max_payload_length")}
    return out.withColumns(shown)


def options(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with problem and the options of the queue that a FORMAT record describes; a queue opens if problem is null."""
    f = B.decode_format(F.col(column))
    out = K.once(files, "_f", f)
    ok = K.options_ok(*[F.col(f"_f.{c}") for c in ("shard_count", "lease_bucket_width_ns", "delayed_bucket_width_ns", "terminal_bucket_width_ns", "max_payload_length")])
    problem = F.coalesce(F.col("_f.error"), F.when(~ok, F.lit("options")))
    names = ("queue_id", "shard_count", "lease_bucket_width_ns", "delayed_bucket_width_ns", "terminal_bucket_width_ns", "max_payload_length")
    return out.withColumns({"problem": problem, **{n: F.when(problem.isNull(), F.col(f"_f.{n}")) for n in names}}).drop("_f")


def load(files: DataFrame, column: str = "content") -> QueueConfig:
    """The configuration of the one queue whose FORMAT record is there; ValueError if it doesn't open."""
    rows = options(files, column).limit(2).collect()
    if len(rows) != 1 or rows[0]["problem"]:
        raise ValueError(f"not a queue: {rows[0]['problem'] if rows else 'no record'}")
    r = rows[0]
    return QueueConfig(r["queue_id"], *[int(r[c]) for c in ("shard_count", "lease_bucket_width_ns", "delayed_bucket_width_ns", "terminal_bucket_width_ns", "max_payload_length")])

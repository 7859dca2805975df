"""The integrity audit: the first failing check of every stored object, and invariants that must give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.schema import FINDINGS, QueueConfig


def severity(finding: Column) -> Column:
    return F.when(finding.isin([f for f, s in FINDINGS if s == "warning"]), "warning").when(finding.isNotNull(), "error")


#: directory -> kinds of names that may lie there
KINDS = {"ready": ("ready", "leased"), "leased": ("leased",), "delayed": ("delayed",), "dead": ("dead",), "receipts": ("receipt",)}
# The quarantine reason of a finding; what can't be opened or has no name isn't moved.
REPAIR_REASONS = {
    "filename_parse_failed": 3, "non_regular_file": 8, "unexpected_hard_link": 9, "receipt_verification_failed": 1,
    "zero_length_publication_residue": 1, "header_read_failed": 1, "header_decode_failed": 1, "header_job_id_mismatch": 5,
    "header_max_attempts_mismatch": 5, "extension_too_large": 1, "extension_read_failed": 1, "envelope_digest_mismatch": 1,
    "file_size_mismatch": 1, "payload_exceeds_limit": 1, "name_tag_mismatch": 4, "shard_placement_mismatch": 4, "payload_digest_mismatch": 2,
}


def _right_kind() -> Column:
    c = F.lit(False)
    for directory, kinds in KINDS.items():
        c = F.when(F.col("directory") == directory, F.col("kind").isin(*kinds)).otherwise(c)
    return F.coalesce(c, F.lit(False))


def attempt_valid(attempt: Column, maximum: Column) -> Column:
    return (maximum > 0) & attempt.between(F.lit(1), maximum)


def shard_in_range(shard_hex: Column, config: QueueConfig) -> Column:
    return F.coalesce(F.conv(shard_hex, 16, 10).cast("long") < config.shard_count, F.lit(False))


def receipt_valid(config: QueueConfig) -> Column:
    """Whether a row of ``sources.with_names`` with content is a sound receipt, full or compact, of its path.

    Name: attempt within the maximum, tag, shard, bucket without overflow.  Compact: record, its fields against the
    name and the bucket, payload limit.  Full: envelope and payload digests, header against the name, payload limit.
    """
    data = F.col("content")
    bucket = F.conv(F.col("bucket_hex"), 16, 10).cast("decimal(20,0)")
    start = K.bucket_start(bucket, F.lit(config.terminal_bucket_width_ns))
    placed = K.hex_field(K.shard(F.lit(config.queue_id), F.col("job_id"), config.shard_count), 4) == F.col("shard_hex")
    name = attempt_valid(F.col("attempt"), F.col("maximum_attempts")) & F.col("tag_ok") & placed & start.isNotNull()
    c, j = B.fields(data, B.RECEIPT), B.fields(data, B.JOB)
    compact = B.decode_receipt(data)["error"].isNull() & (c["job_id"] == F.col("job_id")) & (c["token"] == F.col("token")) & (
        c["final_attempt"] == F.col("attempt")
    ) & (c["bucket_start_ns"] == start) & (c["payload_length"] <= config.max_payload_length)
    full = B.decode_job(data, deep=True)["error"].isNull() & (j["job_id"] == F.col("job_id")) & (
        j["maximum_attempts"] == F.col("maximum_attempts")
    ) & (j["payload_length"] <= config.max_payload_length)
    is_compact = (F.octet_length(data) == 128) & (F.substring(data, 1, 8) == F.lit(B.MAGIC_RECEIPT))
    return F.coalesce(name & F.when(is_compact, compact).otherwise(full), F.lit(False))


def fsck(files: DataFrame, config: QueueConfig, deep: bool = True) -> DataFrame:
    """relative_path, finding, severity for files of ``sources.read_tree`` (quarantine and temporary files aren't visited).

    One CASE, cheap checks first; payload digests are only computed on rows that have passed the checks before.  The
    header is decoded once, in a projection of its own.  What Spark's file reader can't see (names that aren't ASCII, stat, links, reads that
    fail, negative sizes) is checked where the rows have the columns of ``sources.listing``.
    """
    data, head, problem = F.col("content"), F.col("_head"), F.col("_problem")
    seen = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in files.columns else F.lit(False)
    linked = F.coalesce(F.col("links") > 1, F.lit(False)) if "links" in files.columns else F.lit(False)
    visited = files.filter(~F.col("relative_path").startswith("quarantine/"))
    active = F.col("state").isin("ready", "leased", "delayed", "dead")
    readable = active & (F.col("length") >= 128)
    fields = F.struct(*[c.alias(n) for n, c in B.fields(data, B.JOB).items() if n in ("job_id", "maximum_attempts", "payload_length", "payload_digest")])
    visited = visited.withColumns({"_head": F.when(readable, fields), "_problem": F.when(readable, B.decode_job(data)["error"])})
    visited = visited.withColumn("_receipt", F.when(F.col("kind") == "receipt", receipt_valid(config)))
    ordinary = ("header_read_failed", "extension_too_large", "extension_read_failed", "envelope_digest_mismatch", "file_size_mismatch")
    wanted_shard = K.shard(F.lit(config.queue_id), F.col("job_id"), config.shard_count)
    finding = (
        F.when(seen("odd_name"), "invalid_name_encoding")
        .when(F.col("directory").isNull(), "unexpected_entry")
        .when(~_right_kind(), "filename_parse_failed")
        .when(seen("stat_failed"), "stat_failed")
        .when(seen("irregular"), "non_regular_file")
        .when(linked, "unexpected_hard_link")
        .when(seen("open_failed"), "open_failed")
        .when(~F.col("_receipt"), "receipt_verification_failed")
        .when(active & (F.col("length") == 0), "zero_length_publication_residue")
        .when(active & (F.col("length").between(1, 127)), "header_read_failed")
        .when(~problem.isin(*ordinary), "header_decode_failed")
        .when(head["job_id"] != F.col("job_id"), "header_job_id_mismatch")
        .when(head["maximum_attempts"] != F.col("maximum_attempts"), "header_max_attempts_mismatch")
        .when(problem.isNotNull() & (problem != "file_size_mismatch"), problem)
        .when(F.col("length") < 0, "negative_file_size")
        .when(problem.isNotNull(), problem)
        .when(head["payload_length"] > config.max_payload_length, "payload_exceeds_limit")
        .when(~F.coalesce(F.col("tag_ok"), F.lit(False)), "name_tag_mismatch")
        .when(K.hex_field(wanted_shard, 4) != F.col("shard_hex"), "shard_placement_mismatch")
    )
    if deep:
        finding = finding.when(seen("read_failed"), "payload_read_failed").when(head["payload_digest"] != K.payload_digest(B.payload(data)), "payload_digest_mismatch")
    out = K.once(visited, "finding", finding).select("relative_path", "job_id", "finding")
    return out.withColumn("severity", severity(F.col("finding")))


def repair(findings: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """relative_path, finding, severity, reason, quarantine_id, name of the moves that a repair makes, one for each finding with a reason.

    ``quarantined`` is a warning; ``quarantine_failed`` an error, where the quarantine's name is ``taken`` (quarantine_id) already.
    """
    reason = F.lit(None).cast("int")
    for name, code in REPAIR_REASONS.items():
        reason = F.when(F.col("finding") == name, code).otherwise(reason)
    moves = K.once(findings, "reason", reason).select("relative_path", "reason").filter("reason is not null")
    moves = moves.withColumn("quarantine_id", F.md5(F.concat_ws(":", F.lit("quarantine"), "relative_path")))
    moves = moves.withColumn("name", N.quarantine_name(F.col("quarantine_id"), F.col("reason")))
    clash = F.lit(False)
    if taken is not None:
        moves = moves.join(taken.select("quarantine_id").distinct().withColumn("_taken", F.lit(True)), "quarantine_id", "left")
        clash = F.coalesce(F.col("_taken"), F.lit(False))
    moves = moves.withColumn("finding", F.when(clash, "quarantine_failed").otherwise("quarantined"))
    severe = F.when(F.col("finding") == "quarantined", "warning").otherwise("error")
    return moves.select("relative_path", "finding", severe.alias("severity"), "reason", "quarantine_id", "name")


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: 3 with any error, repaired or not, else 0."""
    return findings.agg(F.when(F.count_if(F.col("severity") == "error") > 0, 3).otherwise(0).alias("exit_code"))


def problems(files: DataFrame, config: QueueConfig, deep: bool = True) -> DataFrame:
    """Only the files with a finding."""
    return fsck(files, config, deep).filter("finding is not null")


def report(findings: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """One row: objects, verified, errors, warnings and, given the ``moves`` of a repair, how many objects it quarantined.

    The identities of what was quarantined are rows of ``repair``; they aren't gathered here.
    """
    rows = findings.select("finding", "severity", F.lit(0).alias("moved"))
    if moves is not None:
        rows = rows.union(moves.select("finding", "severity", F.lit(1).alias("moved")))
    object_ = F.col("moved") == 0
    out = rows.agg(
        F.count_if(object_).alias("objects"),
        F.count_if(object_ & F.col("finding").isNull()).alias("verified"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("finding") == "quarantined").alias("quarantined"),
    )
    return out if moves is not None else out.drop("quarantined")


def broken_invariants(objects: DataFrame) -> DataFrame:
    """job_id, invariant for every violation; sound objects give no rows.

    Where rows have ``complete`` (the envelope is whole), no visible object may lack it.
    """
    rules = {
        **({"incomplete_envelope_visible": ~F.col("complete")} if "complete" in objects.columns else {}),
        "lease_has_token": (F.col("state") == "leased") & F.col("token").isNull(),
        "token_only_while_leased": F.col("token").isNotNull() & ~F.col("state").isin("leased", "receipt"),
        "attempt_within_maximum": F.col("attempt") > F.col("maximum_attempts"),
        "delivered_attempt": F.col("state").isin("leased", "receipt") & (F.col("attempt") < 1),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    one = objects.select("job_id", F.explode(broken).alias("invariant"))
    shared = objects.filter("state = 'leased' and token is not null").groupBy("token").agg(F.count("*").alias("n"), F.min("job_id").alias("job_id")).filter("n > 1")
    return one.union(shared.select("job_id", F.lit("unique_active_token").alias("invariant")))

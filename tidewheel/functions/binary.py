"""Fixed binary records: decoders that give fields and the first failing check, and encoders.

Layouts are tables of (field, offset, size); numbers are unsigned and big-endian, other fields bytes in hex.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.kernels import be, domain_digest, hex_of, number, payload_digest
from tidewheel.schema import MAGIC_FORMAT, MAGIC_JOB, MAGIC_RECEIPT, MAGIC_WATERMARK, MAX_EXTENSION, MAX_PAYLOAD

# Fixed values: (field, offset, size, is a number)
FORMAT = (
    ("major", 8, 2, True), ("minor", 10, 2, True), ("flags", 12, 4, True), ("queue_id", 16, 16, False),
    ("created_at_unix_ns", 32, 8, True), ("shard_count", 40, 4, True), ("reserved_a", 44, 4, True),
    ("lease_bucket_width_ns", 48, 8, True), ("delayed_bucket_width_ns", 56, 8, True), ("terminal_bucket_width_ns", 64, 8, True),
    ("max_payload_length", 72, 8, True), ("digest_algorithm", 80, 1, True), ("name_tag_bits", 81, 1, True),
    ("reserved_b", 82, 6, False), ("required_features", 88, 8, True), ("optional_features", 96, 8, True),
    ("reserved_c", 104, 24, False), ("format_digest", 128, 32, False),
)
JOB = (
    ("major", 8, 2, True), ("minor", 10, 2, True), ("extension_length", 12, 4, True), ("payload_length", 16, 8, True),
    ("flags", 24, 4, True), ("digest_algorithm", 28, 1, True), ("reserved_a", 29, 3, False), ("job_id", 32, 16, False),
    ("maximum_attempts", 48, 4, True), ("reserved_b", 52, 4, True), ("created_at_unix_ns", 56, 8, True),
    ("payload_digest", 64, 32, False), ("envelope_digest", 96, 32, False),
)
RECEIPT = (
    ("major", 8, 2, True), ("minor", 10, 2, True), ("job_id", 12, 16, False), ("envelope_digest", 28, 32, False),
    ("final_attempt", 60, 4, True), ("token", 64, 16, False), ("bucket_start_ns", 80, 8, True),
    ("payload_length", 88, 8, True), ("receipt_digest", 96, 32, False),
)
WATERMARK = (
    ("major", 8, 2, True), ("minor", 10, 2, True), ("reserved", 12, 4, True), ("bucket", 16, 8, True),
    ("sequence", 24, 8, True), ("record_digest", 32, 32, False),
)


def fields(data: Column, layout: Sequence[tuple[str, int, int, bool]]) -> dict[str, Column]:
    return {name: number(data, at, size) if is_number else hex_of(data, at, size) for name, at, size, is_number in layout}


def _decoded(data: Column, layout: Sequence, checks: Sequence[tuple[Column, str]]) -> Column:
    """A struct of error (the first failing check; null if none) and the fields; checks are (what must hold, its name)."""
    error = F.lit(None).cast("string")
    for holds, name in reversed(checks):
        error = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(error)
    return F.struct(error.alias("error"), *[c.alias(n) for n, c in fields(data, layout).items()])


def _magic(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, 8) == F.lit(magic)


def decode_format(data: Column) -> Column:
    f = fields(data, FORMAT)
    power = f["shard_count"].cast("long").bitwiseAND(f["shard_count"].cast("long") - 1) == 0
    return _decoded(data, FORMAT, [
        (F.octet_length(data) == 160, "length"), (_magic(data, MAGIC_FORMAT), "magic"), (f["major"] == 1, "major"), (f["flags"] == 0, "flags"),
        (f["digest_algorithm"] == 1, "digest_algorithm"), (f["name_tag_bits"] == 64, "name_tag_bits"),
        ((f["reserved_a"] == 0) & (f["reserved_b"] == "00" * 6) & (f["reserved_c"] == "00" * 24), "reserved"),
        (f["required_features"] == 0, "required_features"),
        (f["format_digest"] == domain_digest("format", F.substring(data, 1, 128)), "digest"),
        (f["shard_count"].between(1, 4096) & power, "shard_count"),
        ((f["lease_bucket_width_ns"] > 0) & (f["delayed_bucket_width_ns"] > 0) & (f["terminal_bucket_width_ns"] > 0), "width"),
        (f["max_payload_length"] <= MAX_PAYLOAD, "max_payload_length"),
    ])


def envelope_digest(data: Column, extension_length: Column) -> Column:
    """Digest of the header, its last 32 bytes zero, and the extension."""
    extension = F.substring(data, F.lit(129), extension_length.cast("int"))
    return domain_digest("envelope", F.substring(data, 1, 96), F.lit(bytes(32)), extension)


def decode_job(data: Column, deep: bool = False) -> Column:
    """Header checks, then the envelope's digest and the size; with ``deep`` also the payload's digest."""
    f = fields(data, JOB)
    extension = f["extension_length"].cast("long")
    checks = [
        (F.octet_length(data) >= 128, "header_read_failed"), (_magic(data, MAGIC_JOB), "magic"), (f["major"] == 1, "major"), (f["flags"] == 0, "flags"),
        (f["digest_algorithm"] == 1, "digest_algorithm"), ((f["reserved_a"] == "000000") & (f["reserved_b"] == 0), "reserved"),
        (f["maximum_attempts"] > 0, "maximum_attempts"), (f["payload_length"] <= MAX_PAYLOAD, "payload_length"),
        (extension <= MAX_EXTENSION, "extension_too_large"), (F.octet_length(data) >= 128 + extension, "extension_read_failed"),
        (f["envelope_digest"] == envelope_digest(data, extension), "envelope_digest_mismatch"),
        (F.octet_length(data) == 128 + extension + f["payload_length"], "file_size_mismatch"),
    ]
    if deep:
        checks.append((f["payload_digest"] == payload_digest(payload(data)), "payload_digest_mismatch"))
    return _decoded(data, JOB, checks)


def payload(data: Column) -> Column:
    extension = number(data, 12, 4).cast("int")
    return F.substring(data, F.lit(129) + extension, F.octet_length(data))


def decode_receipt(data: Column) -> Column:
    """A compact receipt."""
    f = fields(data, RECEIPT)
    return _decoded(data, RECEIPT, [
        (F.octet_length(data) == 128, "length"), (_magic(data, MAGIC_RECEIPT), "magic"), (f["major"] == 1, "major"), (f["minor"] >= 1, "minor"),
        (f["receipt_digest"] == domain_digest("receipt", F.substring(data, 1, 96)), "digest"),
    ])


def decode_watermark(data: Column) -> Column:
    f = fields(data, WATERMARK)
    return _decoded(data, WATERMARK, [
        (F.octet_length(data) == 64, "length"), (_magic(data, MAGIC_WATERMARK), "magic"), (f["major"] == 1, "major"), (f["reserved"] == 0, "reserved"),
        (f["record_digest"] == domain_digest("wall-watermark", F.substring(data, 1, 32)), "digest"),
    ])


def _packed(magic: bytes, layout: Sequence, values: dict[str, Column], until: int) -> Column:
    """The record's bytes before ``until``; fields without a value are zero."""
    parts = [F.lit(magic)]
    for name, at, size, is_number in layout:
        if at >= until:
            break
        if name not in values:
            parts.append(F.lit(bytes(size)))
        else:
            parts.append(be(values[name], size) if is_number else F.unhex(values[name]))
    return F.concat(*parts)


def encode_format(**values: Column) -> Column:
    fixed = {"major": F.lit(1), "minor": F.lit(1), "digest_algorithm": F.lit(1), "name_tag_bits": F.lit(64)}
    head = _packed(MAGIC_FORMAT, FORMAT, fixed | values, 128)
    return F.concat(head, F.unhex(domain_digest("format", head)))


def encode_job(extension: Column, payload: Column, **values: Column) -> Column:
    """values: job_id, maximum_attempts, created_at_unix_ns."""
    fixed = {
        "major": F.lit(1), "minor": F.lit(1), "digest_algorithm": F.lit(1), "extension_length": F.octet_length(extension),
        "payload_length": F.octet_length(payload), "payload_digest": payload_digest(payload),
    }
    head = _packed(MAGIC_JOB, JOB, fixed | values, 96)
    digest = domain_digest("envelope", head, F.lit(bytes(32)), extension)
    return F.concat(head, F.unhex(digest), extension, payload)


def encode_receipt(**values: Column) -> Column:
    head = _packed(MAGIC_RECEIPT, RECEIPT, {"major": F.lit(1), "minor": F.lit(1)} | values, 96)
    return F.concat(head, F.unhex(domain_digest("receipt", head)))


def encode_watermark(bucket: Column, sequence: Column) -> Column:
    head = _packed(MAGIC_WATERMARK, WATERMARK, {"major": F.lit(1), "minor": F.lit(1), "bucket": bucket, "sequence": sequence}, 32)
    return F.concat(head, F.unhex(domain_digest("wall-watermark", head)))

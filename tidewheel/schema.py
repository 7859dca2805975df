"""Queue configuration, enumerations and the transition protocol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The on-disk format names its hash domains, magics, metrics, states, operations and codes so.
HASH_DOMAIN = "SteadQ-1"
METRIC_PREFIX = "steadq"
MAGIC_FORMAT, MAGIC_JOB, MAGIC_RECEIPT, MAGIC_WATERMARK = b"SDQFMT1\0", b"SDQJOB1\0", b"SDQRCPT\0", b"SDQWMR1\0"
STATES = ("ready", "leased", "delayed", "receipt", "dead", "quarantine")
DEAD_REASONS = {
    0: "unspecified",
    1: "consumer_rejected",
    2: "unsupported_content_type",
    3: "administrative_bury",
    4: "attempts_exhausted",
}
QUARANTINE_REASONS = {
    1: "envelope_corrupt",
    2: "payload_corrupt",
    3: "filename_parse_failed",
    4: "filename_tag_failed",
    5: "filename_header_mismatch",
    6: "unsupported_required_feature",
    7: "duplicate_state_conflict",
    8: "non_regular_file",
    9: "unexpected_hard_link",
    10: "cross_device_object",
    11: "impossible_state_transition",
}
# operation, source, destination, generation, attempt, token, reason, clock
PROTOCOL = (
    ("enqueue_immediate", "hidden", "ready", "zero", "zero", "none", "none", "authenticated_wall_floor"),
    ("enqueue_delayed", "hidden", "delayed", "zero", "zero", "none", "none", "authenticated_wall_floor"),
    ("promote", "delayed", "ready", "increment", "unchanged", "none", "none", "authenticated_wall_floor"),
    ("claim", "ready", "leased", "increment", "increment", "new", "none", "boottime_and_authenticated_wall_floor"),
    ("exhausted_ready_cleanup", "ready", "dead", "increment", "unchanged", "none", "attempts_exhausted", "authenticated_wall_floor"),
    ("renew", "leased", "leased", "increment", "unchanged", "same", "none", "boottime_and_authenticated_wall_floor"),
    ("acknowledge", "leased", "receipt", "increment", "unchanged", "same", "none", "authenticated_wall_floor"),
    ("retry_now", "leased", "ready", "increment", "unchanged", "none", "none", "none"),
    ("retry_later", "leased", "delayed", "increment", "unchanged", "none", "none", "authenticated_wall_floor"),
    ("bury", "leased", "dead", "increment", "unchanged", "none", "application_defined", "authenticated_wall_floor"),
    ("reap_expired_to_ready", "leased", "ready", "increment", "unchanged", "none", "none", "lease_expiration_evidence"),
    ("reap_expired_to_dead", "leased", "dead", "increment", "unchanged", "none", "attempts_exhausted", "lease_expiration_evidence_and_authenticated_wall_floor"),
    ("quarantine", "active", "quarantine", "increment", "unchanged", "none", "corruption", "none"),
)
EXIT_CODES = {
    "queue_corrupt": 3, "payload_corrupt": 3, "queue_poisoned": 3, "unsupported_filesystem": 64, "unsupported_format": 64,
    "permission_denied": 5, "resource_exhausted": 4, "state_exhausted": 4, "io_failure": 6, "invalid_clock": 6, "invalid_input": 1,
    "invalid_ticket": 1, "not_committed": 1, "maintenance_busy": 1, "identity_collision": 1,
}
# (finding, severity) in the order of the checks of a stored object
FINDINGS = (
    ("invalid_name_encoding", "error"),
    ("unexpected_entry", "warning"),
    ("filename_parse_failed", "error"),
    ("stat_failed", "error"),
    ("non_regular_file", "error"),
    ("unexpected_hard_link", "error"),
    ("open_failed", "error"),
    ("receipt_verification_failed", "error"),
    ("zero_length_publication_residue", "warning"),
    ("header_read_failed", "error"),
    ("header_decode_failed", "error"),
    ("header_job_id_mismatch", "error"),
    ("header_max_attempts_mismatch", "error"),
    ("extension_too_large", "error"),
    ("extension_read_failed", "error"),
    ("envelope_digest_mismatch", "error"),
    ("negative_file_size", "error"),
    ("file_size_mismatch", "error"),
    ("payload_exceeds_limit", "error"),
    ("name_tag_mismatch", "error"),
    ("shard_placement_mismatch", "error"),
    ("payload_read_failed", "error"),
    ("payload_digest_mismatch", "error"),
)
TICKET_SCHEMA, TICKET_VERSION = f"{METRIC_PREFIX}-transition-ticket", 2
TICKET_OPERATIONS = ("claim", "renew", "acknowledge", "retry_now", "retry_later", "bury")
TICKET_PHASES = ("linearized", "destination_directory_durable", "source_directory_durable")
MAX_PAYLOAD, MAX_EXTENSION = (1 << 40) - 1, 65_536
MIN_LEASE_NS, MAX_LEASE_NS = 10**9, 7 * 86_400 * 10**9

U64_MAX = (1 << 64) - 1
U64 = T.DecimalType(20, 0)

OBJECTS = (
    "queue_id string, job_id string, state string, generation decimal(20,0), attempt long, maximum_attempts long, shard int,"
    " bucket decimal(20,0), boot_id string, boottime_deadline_ns decimal(20,0), wall_deadline_ns decimal(20,0),"
    " not_before_ns decimal(20,0), token string, reason int, tag string, relative_path string"
)
_PLACE = "struct<state string, boot_id string, boottime_deadline_ns decimal(20,0), wall_deadline_ns decimal(20,0), not_before_ns decimal(20,0), terminal_bucket decimal(20,0), reason int>"
TICKET = (
    "schema string, version int, queue_id string, operation string, phase string,"
    " source_identity struct<job_id string, generation decimal(20,0), attempt bigint, maximum_attempts bigint, lease_token string, envelope_digest string, payload_length decimal(20,0)>,"
    f" source {_PLACE}, destination_derivation {_PLACE}"
)


@dataclass(frozen=True)
class QueueConfig:
    """Identity and options of a queue; raises ValueError for options that a queue can't have."""

    queue_id: str = "42" * 16
    shard_count: int = 64
    lease_bucket_width_ns: int = 10_000_000_000
    delayed_bucket_width_ns: int = 10_000_000_000
    terminal_bucket_width_ns: int = 3_600_000_000_000
    max_payload_length: int = MAX_PAYLOAD
    receipt_retention_ns: int = 7 * 86_400 * 10**9
    temporary_ttl_ns: int = 86_400 * 10**9

    def __post_init__(self) -> None:
        n, width = self.shard_count, self.terminal_bucket_width_ns
        if not 1 <= n <= 4096 or n & (n - 1):
            raise ValueError("shard_count is a power of two up to 4096")
        if min(self.lease_bucket_width_ns, self.delayed_bucket_width_ns) <= 0:
            raise ValueError("bucket widths are positive")
        if not 60 * 10**9 <= width <= 86_400 * 10**9 or width % self.delayed_bucket_width_ns:
            raise ValueError("terminal_bucket_width_ns is a minute to a day and a multiple of delayed_bucket_width_ns")
        if not 0 <= self.max_payload_length <= MAX_PAYLOAD:
            raise ValueError("max_payload_length is at most 2^40 - 1")
        if len(self.queue_id) != 32 or set(self.queue_id) - set("0123456789abcdef"):
            raise ValueError("queue_id is 32 lowercase hex digits")


def protocol(spark: SparkSession) -> DataFrame:
    """The 13 edges; a broadcast-sized constant."""
    ddl = "op string, from_state string, to_state string, generation string, attempt string, token string, reason string, clock string"
    return spark.createDataFrame(PROTOCOL, ddl)


def is_legal(source: str, destination: str) -> bool:
    active = {"ready", "leased", "delayed", "receipt", "dead"}
    return any((source == s or s == "active" and source in active) and destination == d for _, s, d, *_ in PROTOCOL)


def valid_lease_duration(ns: int) -> bool:
    return MIN_LEASE_NS <= ns <= MAX_LEASE_NS

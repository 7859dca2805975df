"""Scalar kernels as column expressions: unsigned 64-bit arithmetic, digests, shards, buckets, retry delays.

Unsigned 64-bit values are DECIMAL(20,0); what would leave their range is null (or saturates, where said).
Nothing raises on bad input, so the expressions are safe in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.schema import EXIT_CODES, HASH_DOMAIN, MAX_LEASE_NS, MAX_PAYLOAD, MIN_LEASE_NS, U64, U64_MAX

NO_MORE = (1 << 63) - 1


def whole(x: int, kind: str = "decimal(20,0)") -> Column:
    """A literal of any size."""
    return F.lit(str(x)).cast(kind)


def u64(x: Column | int) -> Column:
    return whole(x) if isinstance(x, int) else x.cast(U64)


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that later expressions and filters refer to without computing it again: a generator of one row keeps the optimizer from copying it."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(column)).alias(name))


def in_range(x: Column, most: int = U64_MAX) -> Column:
    """x as an unsigned value, null outside 0..most."""
    return F.when((x >= 0) & (x <= whole(most, "decimal(38,0)")), x.cast(U64))


def checked_add(a: Column, b: Column) -> Column:
    return in_range(F.try_add(_wide(a), _wide(b)))


def checked_mul(a: Column, b: Column) -> Column:
    return in_range(F.try_multiply(_wide(a), b.cast("decimal(20,0)")).cast("decimal(38,0)"))


def _div(a: Column, b: Column) -> Column:
    """a / b without remainder, exact for all unsigned values."""
    rest = a.cast(U64) % b.cast(U64)
    return F.try_divide((_wide(a) - _wide(rest)).cast(U64), b.cast(U64)).cast(U64)


def bucket_floor(ts: Column, width: Column) -> Column:
    return F.when(width > 0, _div(ts, width))


def bucket_ceil(ts: Column, width: Column) -> Column:
    return F.when(width > 0, F.when(ts.cast(U64) % width.cast(U64) == 0, _div(ts, width)).otherwise((_wide(_div(ts, width)) + 1).cast(U64)))


def eligibility(ts: Column, width: Column) -> Column:
    """(bucket, ns): the first bucket that starts at or after ts, and its start."""
    b = bucket_ceil(ts, width)
    start = checked_mul(b, width)
    return F.when(start.isNotNull(), F.struct(b.alias("bucket"), start.alias("ns")))


def bucket_start(bucket: Column, width: Column) -> Column:
    return checked_mul(bucket, width)


def bucket_end(bucket: Column, width: Column) -> Column:
    return checked_add(bucket_start(bucket, width), width)


def wall_floor(realtime: Column, stored_bucket: Column, width: Column) -> Column:
    return F.greatest(u64(realtime), checked_mul(stored_bucket, width))


# -- bytes and digests


def be(x: Column, size: int) -> Column:
    """Big-endian bytes of an unsigned value."""
    return F.unhex(F.lpad(F.conv(x.cast("string"), 10, 16), 2 * size, "0"))


def number(data: Column, start: int, size: int) -> Column:
    """The unsigned big-endian value at a 0-based place of some bytes."""
    return F.conv(F.hex(F.substring(data, start + 1, size)), 16, 10).cast(U64)


def hex_of(data: Column, start: int, size: int) -> Column:
    return F.lower(F.hex(F.substring(data, start + 1, size)))


def hex_field(x: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.conv(x.cast("string"), 10, 16), digits, "0"))


def is_hex(x: Column, digits: int) -> Column:
    return x.rlike(f"^[0-9a-f]{{{digits}}}\\z")


def from_hex(x: Column, digits: int) -> Column:
    """Bytes of lowercase hex digits; null for anything else."""
    return F.when(is_hex(x, digits), F.unhex(x))


def domain_digest(label: str, *parts: Column) -> Column:
    """SHA-256 in hex, separated by domain."""
    return F.sha2(F.concat(F.lit(f"{HASH_DOMAIN}-{label}".encode() + b"\0"), *parts), 256)


def payload_digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def name_tag(queue_id: Column, context: Column) -> Column:
    return F.substring(domain_digest("name", F.unhex(queue_id), context.cast("binary")), 1, 16)


def shard(queue_id: Column, job_id: Column, shards: int) -> Column:
    h = domain_digest("shard", F.unhex(queue_id), F.unhex(job_id))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(shards - 1).cast("long")).cast("int")


def scan_params(queue_id: Column, boot_id: Column, nonce: Column, scan_round: Column, shards: int) -> Column:
    """(start, stride) of a worker's walk over all shards; ids in hex."""
    h = domain_digest("scan", F.unhex(queue_id), F.unhex(boot_id), F.unhex(nonce), be(scan_round, 8))
    low = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long").bitwiseAND(F.lit(shards - 1).cast("long"))
    stride = low(25).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(F.lit(shards - 1).cast("long"))
    return F.struct(low(9).alias("start"), F.greatest(stride, F.lit(1).cast("long")).alias("stride"))


def shard_at(start: Column, stride: Column, i: Column, shards: int) -> Column:
    return F.pmod(start + stride * i, F.lit(shards))


# -- retry delays


def saturating_double(base: Column, exponent: Column) -> Column:
    """base * 2^(exponent - 1), the largest unsigned value beyond; base for exponent 0."""
    powers = F.array(*[whole(1 << k) for k in range(64)])
    most = whole(U64_MAX, "decimal(38,0)")
    at = F.least(F.greatest(exponent.cast("int"), F.lit(1)), F.lit(64))
    product = F.try_multiply(u64(base), F.element_at(powers, at)).cast("decimal(38,0)")  # null beyond 38 digits
    got = F.when((base == 0) | (exponent == 0), _wide(base)).when(exponent > 64, most).otherwise(F.coalesce(product, most))
    return F.least(got, most).cast(U64)


def effective_cap(cap: Column, max_delay: Column | None) -> Column:
    return cap if max_delay is None else F.least(cap, F.coalesce(max_delay, cap))


def check_policy(base: int, cap: int, max_delay: int | None = None) -> None:
    """Raises ValueError for a retry policy that can't be."""
    if base <= 0:
        raise ValueError("the base delay is positive")
    if (cap if max_delay is None else min(cap, max_delay)) < base:
        raise ValueError("the cap is at least the base delay")


def policy_ok(base: Column, cap: Column) -> Column:
    """Whether a base delay and the cap in effect make a retry policy."""
    return (base > 0) & (cap >= base)


def midpoint(lower: Column, span: Column) -> Column:
    return (_wide(lower) + _wide(_div(span, u64(2)))).cast(U64)


def lease_duration_ok(ns: Column) -> Column:
    return ns.between(MIN_LEASE_NS, MAX_LEASE_NS)


def options_ok(shards: Column, lease_width: Column, delayed_width: Column, terminal_width: Column, max_payload: Column) -> Column:
    """Whether a queue can have these options: shards a power of two up to 4096, widths positive, the terminal width a
    minute to a day and a multiple of the delayed width, payloads up to 2^40 - 1.
    """
    n = shards.cast("long")
    power = n.between(1, 4096) & (n.bitwiseAND(n - 1) == 0)
    end = terminal_width.between(60 * 10**9, 86_400 * 10**9) & (terminal_width.cast(U64) % delayed_width.cast(U64) == 0)
    return F.coalesce(power & (lease_width > 0) & (delayed_width > 0) & end & max_payload.between(0, MAX_PAYLOAD), F.lit(False))


def exit_code(error: Column) -> Column:
    """The command line's exit code for an error; 1 for one that isn't known, 0 for none."""
    c = F.when(error.isNull(), 0).otherwise(1)
    for code in sorted(set(EXIT_CODES.values()) - {1}):
        c = F.when(error.isin(*[e for e, x in EXIT_CODES.items() if x == code]), code).otherwise(c)
    return c


def retry_ceiling(base: Column, cap: Column, attempt: Column) -> Column:
    return F.when(attempt == 0, u64(0)).otherwise(F.least(u64(cap), saturating_double(base, attempt)))


def retry_delay(queue_id: Column, job_id: Column, base: Column, cap: Column, attempt: Column) -> Column:
    """Delay with jitter: uniform between half the ceiling and the ceiling, by rejection over 64 digests, else the middle.

    The first digest is nearly always accepted; the others are only computed where it isn't.
    """
    def draw(counter: Column) -> Column:
        h = domain_digest("jitter", F.unhex(queue_id), F.unhex(job_id), be(attempt, 4), be(counter, 4))
        return F.conv(F.substring(h, 1, 16), 16, 10).cast(U64)

    def jittered(c: Column) -> Column:
        lower = (_wide(c) + _wide(c) % 2) / 2
        lower = lower.cast("decimal(38,0)")
        span = _wide(c) - lower + 1
        return bind(F.struct(lower.alias("lower"), span.cast(U64).alias("span")), pick)

    def pick(s: Column) -> Column:
        threshold = (whole(1 << 64, "decimal(38,0)") - s["span"]) % s["span"]

        def accepted(x: Column) -> Column:
            return F.when(x >= threshold, (s["lower"] + x % s["span"]).cast(U64))

        # draws stop counting once one is accepted, so the digest is computed once for nearly every row
        none = F.lit(None).cast(U64)
        found = F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda got, n: F.when(got.isNotNull(), got).otherwise(bind(draw(n), accepted)))
        return F.coalesce(found, (s["lower"] + _div(s["span"], u64(2))).cast(U64))

    return F.when(attempt == 0, u64(0)).otherwise(bind(retry_ceiling(base, cap, attempt), jittered))


def retry_deadline(floor: Column, delay: Column) -> Column:
    return in_range(F.try_add(_wide(floor), _wide(delay)), NO_MORE)


# -- text


def boot_hex(dashed: Column) -> Column:
    """32 hex digits of a dashed boot id; null for another form."""
    ok = dashed.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z")
    return F.when(ok, F.translate(dashed, "-", ""))


def boot_dashed(digits: Column) -> Column:
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(is_hex(digits, 32), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cut]))


def safe_component(name: Column) -> Column:
    """A path component without separators, NUL or dots alone."""
    return (F.octet_length(name).between(1, 255)) & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\0")


def safe_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return (F.length(path) > 0) & F.forall(parts, safe_component)


def total_size(extension: Column, payload: Column) -> Column:
    return checked_add(checked_add(u64(128), u64(extension)), u64(payload))


def escaped(name: Column) -> Column:
    """A name as it is if it is printable ASCII without a backslash, else its bytes as \\xNN."""
    odd = F.regexp_replace(F.lower(F.hex(name.cast("binary"))), "(..)", r"\\x$1")
    return F.when(name.rlike(r"^[\x20-\x5b\x5d-\x7e]*$"), name).otherwise(odd)


def metadata_key_ok(key: Column) -> Column:
    return F.coalesce(key.rlike("^[a-z0-9][a-z0-9._-]{0,63}\\z"), F.lit(False))


def metadata_ok(metadata: Column) -> Column:
    """A map of text: 256 entries at most, keys by the grammar, values of 4096 bytes at most."""
    return (F.size(metadata) <= 256) & F.forall(F.map_keys(metadata), metadata_key_ok) & F.forall(F.map_values(metadata), lambda v: F.octet_length(v) <= 4096)


def content_type_ok(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(r"^[\x20-\x7e]{1,255}\z"), F.lit(False))

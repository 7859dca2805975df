"""File names of stored objects: writers, and parsers that give null for what isn't a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.kernels import boot_dashed, boot_hex, bucket_floor, hex_field, name_tag, once, u64

_COMMON = "[0-9a-f]{32}\\.g[0-9a-f]{16}\\.a[0-9a-f]{8}\\.m[0-9a-f]{8}"
_TAG = "\\.k[0-9a-f]{16}\\."
# The grammar of each kind of name.
GRAMMARS = {
    "ready": f"^{_COMMON}{_TAG}sqj\\z",
    "leased": f"^{_COMMON}\\.o[0-9a-f]{{32}}\\.b[0-9a-f]{{16}}\\.w[0-9a-f]{{16}}\\.t[0-9a-f]{{32}}{_TAG}sqj\\z",
    "delayed": f"^{_COMMON}\\.d[0-9a-f]{{16}}{_TAG}sqj\\z",
    "dead": f"^{_COMMON}\\.x[0-9a-f]{{4}}{_TAG}sqj\\z",
    "receipt": f"^{_COMMON}\\.t[0-9a-f]{{32}}{_TAG}rct\\z",
    "temp": "^[0-9a-f]{16}\\.[0-9a-f]{32}\\.tmp\\z",
    "quarantine": "^q[0-9a-f]{32}\\.x[0-9a-f]{4}\\.raw\\z",
}
_FIRST = ("job_id", "generation", "attempt", "maximum_attempts")
#: What stands between the dots, in order; all but the first part (and a temporary name's second) have a letter before.
PARTS = {
    "ready": (*_FIRST, "tag"),
    "leased": (*_FIRST, "boot_id", "boottime_deadline_ns", "wall_deadline_ns", "token", "tag"),
    "delayed": (*_FIRST, "not_before_ns", "tag"),
    "dead": (*_FIRST, "reason", "tag"),
    "receipt": (*_FIRST, "token", "tag"),
    "temp": ("created_boottime_ns", "random"),
    "quarantine": ("quarantine_id", "reason"),
}
FIELDS = (*_FIRST, "boot_id", "boottime_deadline_ns", "wall_deadline_ns", "not_before_ns", "token", "reason", "tag", "created_boottime_ns", "random", "quarantine_id")
_TEXT = {"job_id", "boot_id", "token", "tag", "random", "quarantine_id"}
_LONG = {"attempt", "maximum_attempts", "reason"}


def base_name(job_id: Column, generation: Column, attempt: Column, maximum: Column) -> Column:
    return F.concat(job_id, F.lit(".g"), hex_field(generation, 16), F.lit(".a"), hex_field(attempt, 8), F.lit(".m"), hex_field(maximum, 8))


def shard_dir(shard: Column) -> Column:
    return hex_field(shard, 4)


def bucket_dir(bucket: Column) -> Column:
    return hex_field(bucket, 16)


def tagged(queue: Column, context: Column, base: Column, end: Column | str) -> Column:
    return _joined(base, ".k", name_tag(queue, F.concat(context, base)), end)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# What a tagged name is made of: the tag's context, the name before the tag, its end.


def ready_parts(shard_hex: Column, base: Column) -> tuple[Column, Column, str]:
    return _joined("ready/-/-/", shard_hex, "/"), base, ".sqj"


def delayed_parts(bucket_hex: Column, shard_hex: Column, base: Column, not_before: Column) -> tuple[Column, Column, str]:
    return _joined("delayed/-/", bucket_hex, "/", shard_hex, "/"), _joined(base, ".d", hex_field(not_before, 16)), ".sqj"


def leased_parts(boot: Column, bucket_hex: Column, shard_hex: Column, base: Column, boottime: Column, wall: Column, token: Column) -> tuple[Column, Column, str]:
    """boot: the dashed boot id."""
    full = _joined(base, ".o", F.coalesce(boot_hex(boot), F.lit("0" * 32)), ".b", hex_field(boottime, 16), ".w", hex_field(wall, 16), ".t", token)
    return _joined("leased/", boot, "/", bucket_hex, "/", shard_hex, "/"), full, ".sqj"


def receipt_parts(bucket_hex: Column, shard_hex: Column, base: Column, token: Column) -> tuple[Column, Column, str]:
    return _joined("receipts/-/", bucket_hex, "/", shard_hex, "/"), _joined(base, ".t", token), ".rct"


def dead_parts(bucket_hex: Column, shard_hex: Column, base: Column, reason: Column) -> tuple[Column, Column, str]:
    return _joined("dead/-/", bucket_hex, "/", shard_hex, "/"), _joined(base, ".x", hex_field(reason, 4)), ".sqj"


def ready_name(queue: Column, shard: Column, base: Column) -> Column:
    return tagged(queue, *ready_parts(shard_dir(shard), base))


def delayed_name(queue: Column, bucket: Column, shard: Column, base: Column, not_before: Column) -> Column:
    return tagged(queue, *delayed_parts(bucket_dir(bucket), shard_dir(shard), base, not_before))


def leased_name(queue: Column, boot: Column, bucket: Column, shard: Column, base: Column, boottime: Column, wall: Column, token: Column) -> Column:
    """boot: the dashed boot id."""
    return tagged(queue, *leased_parts(boot, bucket_dir(bucket), shard_dir(shard), base, boottime, wall, token))


def receipt_name(queue: Column, bucket: Column, shard: Column, base: Column, token: Column) -> Column:
    return tagged(queue, *receipt_parts(bucket_dir(bucket), shard_dir(shard), base, token))


def dead_name(queue: Column, bucket: Column, shard: Column, base: Column, reason: Column) -> Column:
    return tagged(queue, *dead_parts(bucket_dir(bucket), shard_dir(shard), base, reason))


def temp_name(created_boottime: Column, random: Column) -> Column:
    return _joined(hex_field(created_boottime, 16), ".", random, ".tmp")


def quarantine_name(quarantine_id: Column, reason: Column) -> Column:
    return _joined("q", quarantine_id, ".x", hex_field(reason, 4), ".raw")


def kind_of(name: Column) -> Column:
    """Which grammar a name follows; null for none.

    The number of parts and one letter say which it can be, so that one pattern is tried on a name.
    """
    parts = F.split(name, "\\.")
    n, letter = F.size(parts), F.substring(F.get(parts, F.lit(4)), 1, 1)
    last = F.try_element_at(parts, F.lit(-1))
    may_be = {
        "ready": n == 6, "leased": n == 10, "delayed": (n == 7) & (letter == "d"), "dead": (n == 7) & (letter == "x"),
        "receipt": (n == 7) & (letter == "t"), "temp": (n == 3) & (last == "tmp"), "quarantine": (n == 3) & (last == "raw"),
    }
    c = F.lit(None).cast("string")
    for kind, can in may_be.items():
        c = F.when(can, F.when(name.rlike(GRAMMARS[kind]), F.lit(kind))).otherwise(c)
    return c


def field(name: Column, kind: Column, wanted: str) -> Column:
    """A field of a name of a known kind; null where there is none."""
    parts, c = F.split(name, "\\."), F.lit(None).cast("string")
    for k, fields in PARTS.items():
        if wanted in fields:
            at = fields.index(wanted)
            bare = k == "temp" or at == 0 and k != "quarantine"
            part = F.get(parts, F.lit(at))
            c = F.when(kind == k, part if bare else F.substring(part, 2, 64)).otherwise(c)
    if wanted in _TEXT:
        return c
    value = u64(F.conv(c, 16, 10))
    return value.cast("long") if wanted in _LONG else value


def lease_bucket(boottime_deadline: Column, width_ns: int) -> Column:
    return bucket_floor(boottime_deadline, F.lit(width_ns))


def with_parsed(
    df: DataFrame, name: str = "name", bucket: str | None = None, shard_hex: str | None = None, queue_id: str | None = None, lease_width_ns: int = 10_000_000_000
) -> DataFrame:
    """``df`` with kind, the fields of the name and, given the names of directory columns and the queue, whether the tag is right (tag_ok).

    A lease's tag stands for the bucket of its deadline: leases that lie with the ready objects have no bucket directory.
    """
    df = once(df, "kind", kind_of(F.col(name)))
    df = df.withColumns({w: field(F.col(name), F.col("kind"), w) for w in FIELDS})
    if queue_id is None:
        return df
    base = F.regexp_extract(name, "^(.*)\\.k[0-9a-f]{16}\\.(sqj|rct)\\z", 1)
    kind, at = F.col("kind"), F.coalesce(F.col(bucket), F.lit("-"))
    of_deadline = bucket_dir(lease_bucket(F.col("boottime_deadline_ns"), lease_width_ns))
    lease = F.concat(F.lit("leased/"), boot_dashed(F.col("boot_id")), F.lit("/"), F.coalesce(F.col(bucket), of_deadline))
    home = F.when(kind == "ready", F.lit("ready/-/-")).when(kind == "leased", lease).when(
        kind == "receipt", F.concat(F.lit("receipts/-/"), at)
    ).otherwise(F.concat(kind, F.lit("/-/"), at))
    return df.withColumn("tag_ok", name_tag(F.lit(queue_id), F.concat(home, F.lit("/"), F.col(shard_hex), F.lit("/"), base)) == F.col("tag"))


def parse_path(path: Column) -> dict[str, Column]:
    """state directory, bucket, shard and name of a relative path: ready/SHARD/NAME, STATE/BUCKET/SHARD/NAME or leased/BOOT/BUCKET/SHARD/NAME."""
    parts = F.split(path, "/")
    n = F.size(parts)
    get = lambda back: F.try_element_at(parts, F.lit(-back))
    ok = (n == 3) & (get(3) == "ready") | (n == 4) & get(4).isin("delayed", "receipts", "dead") | (n == 5) & (get(5) == "leased")
    return {
        "directory": F.when(ok, F.get(parts, F.lit(0))),
        "bucket_hex": F.when(ok & (n > 3) & get(3).rlike("^[0-9a-f]{16}$"), get(3)),
        "shard_hex": F.when(ok & get(2).rlike("^[0-9a-f]{4}$"), get(2)),
        "name": get(1),
    }

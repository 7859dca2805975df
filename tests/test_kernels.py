"""Pinned vectors, edges of unsigned arithmetic, names and records."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.schema import PROTOCOL, QueueConfig, is_legal, protocol, valid_lease_duration

TOP = (1 << 64) - 1


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


def test_pinned_vectors(value):
    q, j, zero = F.lit("42" * 16), F.lit("ab" * 16), F.lit("00" * 16)
    assert value(K.shard(q, j, 64)) == 36
    assert tuple(value(K.scan_params(q, zero, zero, F.lit(0), 64))) == (46, 23)
    job = F.lit("0b050201" + "00" * 12)
    assert value(K.retry_delay(zero, job, K.whole(1 << 62), K.whole(1 << 63), F.lit(2))) == 6775448086808226869
    assert value(K.domain_digest("format", F.lit(bytes(128)))) == "9707cc37ed7f1025a4c3b066c83051c6353c5aa3be9b6650940f03acf288961c"
    assert value(K.domain_digest("receipt", F.lit(bytes(96)))) == "544b0c70aa840523646a75befda7f513967631287f0ed4430993212840ae16c9"
    assert value(K.domain_digest("wall-watermark", F.lit(bytes(32)))) == "58e096acae632c52bb6cc30d24c156eb7d45b7586475d987f13670e1193dbaca"
    job = B.encode_job(F.lit(b""), F.lit(b"hello"), job_id=j, maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(0))
    assert value(B.decode_job(job, deep=True))["envelope_digest"] == "80ab8359194ffd2442d2bc3afdaebdc6089afb00bd04a772c2097b03723da561"


def test_jittered_delays(value):
    got = [value(K.retry_delay(F.lit("42" * 16), F.lit("01" * 16), F.lit(1000), F.lit(60000), F.lit(a))) for a in (0, 1, 2, 3, 10)]
    assert got == [0, 688, 1701, 2067, 39528]


@pytest.mark.parametrize(("base", "exponent", "want"), [(1, 64, 1 << 63), (1, 65, TOP), (TOP, 2, TOP), (1000, 0, 1000), (0, 9, 0), (3, 2, 6)])
def test_saturating_double(value, base, exponent, want):
    assert value(K.saturating_double(K.whole(base), F.lit(exponent))) == want


def test_backoff(value):
    got = [value(K.retry_ceiling(F.lit(1000), F.lit(300_000), F.lit(a))) for a in (1, 2, 3, 9, 10)]
    assert got == [1000, 2000, 4000, 256_000, 300_000]
    cap = K.effective_cap(F.lit(300_000), F.lit(1500))
    assert value(K.retry_ceiling(F.lit(1000), cap, F.lit(2))) == 1500
    for bad in ((0, 1, None), (10, 5, None), (10, 50, 5)):
        with pytest.raises(ValueError):
            K.check_policy(*bad)


def test_unsigned_edges(value):
    top, one = K.whole(TOP), K.whole(1)
    assert value(K.checked_add(top, one)) is None and value(K.checked_add(K.whole(TOP - 1), one)) == TOP
    assert value(K.checked_mul(top, K.whole(2))) is None and value(K.checked_mul(K.whole(1 << 32), K.whole(1 << 31))) == 1 << 63
    assert value(K.bucket_floor(top, one)) == TOP and value(K.bucket_floor(top, K.whole(0))) is None
    assert value(K.bucket_ceil(top, K.whole(10))) == TOP // 10 + 1 and value(K.bucket_ceil(K.whole(20), K.whole(10))) == 2
    assert value(K.eligibility(top, K.whole(10))) is None and tuple(value(K.eligibility(K.whole(11), K.whole(10)))) == (2, 20)
    assert value(K.bucket_end(K.whole(3), K.whole(10))) == 40 and value(K.bucket_end(top, one)) is None
    assert value(K.retry_deadline(K.whole(1 << 62), K.whole(1 << 62))) is None and value(K.retry_deadline(K.whole(5), K.whole(6))) == 11
    assert value(K.wall_floor(F.lit(5), F.lit(2), F.lit(10))) == 20
    assert value(K.total_size(F.lit(3), F.lit(4))) == 135


def test_text_kernels(value):
    dashed = "01234567-89ab-cdef-0123-456789abcdef"
    assert value(K.boot_hex(F.lit(dashed))) == dashed.replace("-", "") and value(K.boot_hex(F.lit(dashed.upper()))) is None
    assert value(K.boot_dashed(F.lit(dashed.replace("-", "")))) == dashed
    assert value(K.from_hex(F.lit("0aff"), 4)) == b"\x0a\xff" and value(K.from_hex(F.lit("0AFF"), 4)) is None
    assert value(K.safe_path(F.lit("a/b"))) and not value(K.safe_path(F.lit("a/../b"))) and not value(K.safe_path(F.lit("/a")))
    assert value(K.escaped(F.lit("ok name"))) == "ok name" and value(K.escaped(F.lit("é"))) == "\\xc3\\xa9"
    assert value(K.metadata_ok(F.create_map(F.lit("a.b"), F.lit("v")))) and not value(K.metadata_ok(F.create_map(F.lit("A"), F.lit("v"))))
    assert not value(K.metadata_key_ok(F.lit("a" * 65))) and not value(K.content_type_ok(F.lit("")))


def test_names(spark, value):
    q, s = F.lit("42" * 16), F.lit(5)
    base = N.base_name(F.lit("ab" * 16), F.lit(7), F.lit(2), F.lit(3))
    boot = F.lit("01234567-89ab-cdef-0123-456789abcdef")
    made = {
        "ready": (N.ready_name(q, s, base), 92, None),
        "delayed": (N.delayed_name(q, F.lit(9), s, base, F.lit(90)), 110, "0" * 15 + "9"),
        "dead": (N.dead_name(q, F.lit(9), s, base, F.lit(4)), 98, "0" * 15 + "9"),
        "receipt": (N.receipt_name(q, F.lit(9), s, base, F.lit("cd" * 16)), 126, "0" * 15 + "9"),
        "leased": (N.leased_name(q, boot, F.lit(9), s, base, F.lit(1), F.lit(2), F.lit("cd" * 16)), 196, "0" * 15 + "9"),
        "temp": (N.temp_name(F.lit(1), F.lit("ef" * 16)), 53, None),
        "quarantine": (N.quarantine_name(F.lit("ef" * 16), F.lit(2)), 43, None),
    }
    for kind, (column, length, bucket) in made.items():
        name = value(column)
        assert len(name) == length
        df = spark.createDataFrame([(name, bucket, "0005"), (name.upper(), bucket, "0005"), (name + "x", bucket, "0005")], "name string, b string, s string")
        good, *bad = N.with_parsed(df, "name", "b", "s", "42" * 16).collect()
        assert good["kind"] == kind and all(r["kind"] is None for r in bad)
        if kind not in ("temp", "quarantine"):
            assert good["tag_ok"] and (good["job_id"], good["generation"], good["attempt"], good["maximum_attempts"]) == ("ab" * 16, Decimal(7), 2, 3)
    path = N.parse_path(F.lit("delayed/" + "0" * 16 + "/0005/x"))
    assert [value(path[k]) for k in ("directory", "bucket_hex", "shard_hex", "name")] == ["delayed", "0" * 16, "0005", "x"]
    assert value(N.parse_path(F.lit("other/0005/x"))["directory"]) is None


def test_records(value):
    mark = B.encode_watermark(F.lit(12), F.lit(3))
    got = value(B.decode_watermark(mark))
    assert (got["error"], got["bucket"], got["sequence"]) == (None, 12, 3)
    assert value(B.decode_watermark(F.concat(mark, F.lit(b"x"))))["error"] == "length"
    assert value(B.decode_watermark(F.concat(F.lit(b"SDQWMR2\0"), F.substring(mark, 9, 56))))["error"] == "magic"
    assert value(B.decode_watermark(F.concat(F.substring(mark, 1, 16), F.lit(bytes(8)), F.substring(mark, 25, 40))))["error"] == "digest"
    r = B.encode_receipt(job_id=F.lit("ab" * 16), envelope_digest=F.lit("00" * 32), final_attempt=F.lit(2), token=F.lit("cd" * 16), bucket_start_ns=F.lit(7), payload_length=F.lit(5))
    got = value(B.decode_receipt(r))
    assert (got["error"], got["job_id"], got["final_attempt"], got["token"]) == (None, "ab" * 16, 2, "cd" * 16)
    assert value(B.decode_receipt(F.lit(b"")))["error"] == "length"
    job = B.encode_job(F.lit(b"\xa1\x02\x61x"), F.lit(b"hello"), job_id=F.lit("ab" * 16), maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(0))
    assert value(B.decode_job(job, deep=True))["error"] is None and value(B.payload(job)) == b"hello"
    wrong = F.concat(F.substring(job, 1, 136), F.lit(b"O"))
    assert value(B.decode_job(wrong))["error"] is None and value(B.decode_job(wrong, deep=True))["error"] == "payload_digest_mismatch"
    assert value(B.decode_job(F.concat(job, F.lit(b"!"))))["error"] == "file_size_mismatch"


def test_protocol_and_options(spark):
    assert protocol(spark).count() == len(PROTOCOL) == 13
    assert is_legal("ready", "leased") and is_legal("dead", "quarantine") and not is_legal("receipt", "ready") and not is_legal("quarantine", "quarantine")
    assert valid_lease_duration(10**9) and not valid_lease_duration(10**9 - 1)
    for bad in ({"shard_count": 3}, {"shard_count": 8192}, {"terminal_bucket_width_ns": 61 * 10**9}, {"queue_id": "X" * 32}, {"max_payload_length": 1 << 40}):
        with pytest.raises(ValueError):
            QueueConfig(**bad)

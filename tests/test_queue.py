"""Transitions, lookups, audit, recovery and streams on small rows."""

from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.operators import audit, lookup, recovery, stats
from tidewheel.operators import transitions as X
from tidewheel.plans import queries as P
from tidewheel.sources import tables as S
from tidewheel.streaming import leases

CONFIG, BOOT = S.CONFIG, "0f" * 16


def test_claim_respects_attempts_and_shards(spark):
    rows = [(f"{i:032x}", i % 2, i % 3, 2, i, 0) for i in range(30)]
    ready = spark.createDataFrame(rows, "job_id string, shard int, attempt long, maximum_attempts long, created_ns long, generation long")
    got = X.claim(ready, 4, 10**18, 10**12, 10**10, BOOT, CONFIG).collect()
    assert len(got) == 8 and all(r["attempt"] <= r["maximum_attempts"] and r["generation"] == 1 for r in got)
    assert len({r["token"] for r in got}) == 8
    assert X.bury_exhausted(ready, 10**18, CONFIG).count() == 10


def test_retry_routes(spark):
    rows = [("a", 1, 3, 1, 50), ("b", 3, 3, 1, 50), ("c", 1, 3, 1, 10)]
    leased = spark.createDataFrame(rows, "job_id string, attempt long, maximum_attempts long, generation long, until long")
    got = {r["job_id"]: r for r in X.retry(leased, F.lit(10), F.col("until"), CONFIG).collect()}
    assert [got[k]["effective_op"] for k in "abc"] == ["retry_later", "bury", "retry_now"]
    assert got["b"]["reason"] == 4 and got["a"]["generation"] == 2


def test_held_and_duplicate(spark):
    lease = spark.createDataFrame([("a", 1, "t")], "job_id string, generation long, token string")
    ask = spark.createDataFrame([("a", 1, "t"), ("a", 1, "stale"), ("a", 2, "t")], "job_id string, generation long, token string")
    assert sorted(r["outcome"] for r in X.held(lease, ask).collect()) == ["committed", "lease_lost", "lease_lost"]


def test_invariants(spark):
    rows = [("a", "leased", "t", 1, 3), ("b", "leased", "t", 1, 3), ("c", "leased", None, 1, 3), ("d", "ready", "x", 0, 3), ("e", "receipt", "y", 0, 3), ("f", "ready", None, 4, 3), ("g", "ready", None, 0, 3)]
    o = spark.createDataFrame(rows, "job_id string, state string, token string, attempt long, maximum_attempts long")
    got = {(r["job_id"], r["invariant"]) for r in audit.broken_invariants(o).collect()}
    assert got == {("a", "unique_active_token"), ("c", "lease_has_token"), ("d", "token_only_while_leased"), ("e", "delivered_attempt"), ("f", "attempt_within_maximum")}


def _tree(spark):
    """(name, relative path, content, expected finding) of one object for each rule that a reader can see."""
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    job = "ab" * 16
    q, j = F.lit(CONFIG.queue_id), F.lit(job)
    shard = value(K.shard(q, j, 64))
    data = bytes(value(B.encode_job(F.lit(b""), F.lit(b"hello"), job_id=j, maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(0))))
    at = lambda job_id=job, maximum=3, s=shard, tag_shard=None: f"ready/{s:04x}/" + value(
        N.ready_name(q, F.lit(s if tag_shard is None else tag_shard), N.base_name(F.lit(job_id), F.lit(0), F.lit(0), F.lit(maximum)))
    )
    other = "cd" * 16
    other_shard = value(K.shard(q, F.lit(other), 64))
    base = N.base_name(j, F.lit(2), F.lit(1), F.lit(3))
    receipt = f"receipts/{1:016x}/{shard:04x}/" + value(N.receipt_name(q, F.lit(1), F.lit(shard), base, F.lit("ee" * 16)))
    record = bytes(value(B.encode_receipt(job_id=j, envelope_digest=F.lit("00" * 32), final_attempt=F.lit(1), token=F.lit("ee" * 16), bucket_start_ns=F.lit(CONFIG.terminal_bucket_width_ns), payload_length=F.lit(5))))
    late = receipt.replace("receipts/" + "0" * 15 + "1", "receipts/" + "0" * 15 + "2")
    boot, deadline = "01234567-89ab-cdef-0123-456789abcdef", 95 * 10**9
    lease = lambda bucket: value(N.leased_name(q, F.lit(boot), F.lit(bucket), F.lit(shard), base, F.lit(deadline), F.lit(2), F.lit("ee" * 16)))
    delayed = value(N.delayed_name(q, F.lit(1), F.lit(shard), base, F.lit(10**9)))
    wrong = (shard + 1) % 64
    return [
        (at(), data, None),
        (receipt, data, None),
        (receipt.replace("receipts/", "receipts/", 1), record, None),
        (receipt, record[:-1] + b"\0", "receipt_verification_failed"),
        (late, record, "receipt_verification_failed"),
        (receipt.replace(f"/{shard:04x}/", f"/{wrong:04x}/"), record, "receipt_verification_failed"),
        (receipt, data[:-1] + b"O", "receipt_verification_failed"),
        (f"ready/{shard:04x}/" + lease(9), data, None),
        (f"leased/{boot}/{9:016x}/{shard:04x}/" + lease(9), data, None),
        (f"ready/{shard:04x}/" + lease(8), data, "name_tag_mismatch"),
        (f"ready/{shard:04x}/" + delayed, data, "filename_parse_failed"),
        ("ready/readme", data, "unexpected_entry"),
        (f"ready/{shard:04x}/nonsense.sqj", data, "filename_parse_failed"),
        (at(), b"", "zero_length_publication_residue"),
        (at(), data[:100], "header_read_failed"),
        (at(), b"X" + data[1:], "header_decode_failed"),
        (at(other, s=other_shard), data, "header_job_id_mismatch"),
        (at(maximum=4), data, "header_max_attempts_mismatch"),
        (at(), data[:12] + b"\xff" * 4 + data[16:], "extension_too_large"),
        (at(), data[:12] + b"\0\0\1\0" + data[16:], "extension_read_failed"),
        (at(), data[:96] + bytes(32) + data[128:], "envelope_digest_mismatch"),
        (at(), data + b"!", "file_size_mismatch"),
        (at(tag_shard=wrong), data, "name_tag_mismatch"),
        (at(s=wrong), data, "shard_placement_mismatch"),
        (at(), data[:-1] + b"O", "payload_digest_mismatch"),
        ("quarantine/q" + "ab" * 16 + ".x0002.raw", b"", "not visited"),
    ]


def test_fsck_ladder(spark):
    tree = _tree(spark)
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c, _) in enumerate(tree)], "i int, relative_path string, content binary")
    files = S.with_names(df.withColumn("length", F.octet_length("content")))
    for i, (path, _, want) in enumerate(tree):
        if want == "not visited":
            assert audit.fsck(files.filter(F.col("i") == i), CONFIG).count() == 0
    visited = [i for i, (_, _, want) in enumerate(tree) if want != "not visited"]
    rows = audit.fsck(files.filter(F.col("i").isin(visited)).withColumn("relative_path", F.concat_ws("|", "i", "relative_path")), CONFIG).collect()
    got = {int(r["relative_path"].split("|")[0]): r["finding"] for r in rows}
    assert got == {i: want for i, (_, _, want) in enumerate(tree) if want != "not visited"}


def test_tree_on_disk(spark, tmp_path):
    good = [(p, c) for p, c, want in _tree(spark) if want is None][:2]
    S.write_tree(spark.createDataFrame([(p, bytearray(c)) for p, c in good], "relative_path string, content binary"), str(tmp_path))
    files = S.read_tree(spark, str(tmp_path))
    assert sorted(r["state"] for r in files.select("state").collect()) == ["ready", "receipt"]
    assert audit.report(audit.fsck(files, CONFIG)).first().asDict() == {"objects": 2, "verified": 2, "errors": 0, "warnings": 0}
    assert stats.scan_stats(files).first()["entries"] == 2


def test_recovery_is_idempotent_and_resumes(spark, small):
    rows = S.jobs(spark, small).select("job_id", "shard", (F.col("created_ns") % 7).alias("bucket"))
    everything = [tuple(r) for r in recovery.take(rows, None, 10**6).select("bucket", "shard", "job_id").collect()]
    cursor, done = None, []
    for _ in range(50):
        part, cursor = recovery.step(rows, cursor, 400)
        done += [tuple(r) for r in part.select("bucket", "shard", "job_id").collect()]
        if cursor is None:
            break
    assert done == everything
    o = S.jobs(spark, small).select("job_id", "shard", F.lit("delayed").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("attempt"), "maximum_attempts",
                                    F.lit(1).cast("long").alias("bucket"), F.lit(None).cast("string").alias("boot_id"), F.lit(None).cast("long").alias("deadline_ns"), F.lit(None).cast("int").alias("reason"))
    after, report = recovery.recover(o, S.NOW_NS, BOOT, CONFIG)
    assert {(r["phase"], r["state"]) for r in report.collect()} == {("promote", "ready")}
    again, report = recovery.recover(after, S.NOW_NS, BOOT, CONFIG)
    assert report.count() == 0 and again.count() == o.count()


def _fold(rows, seconds):
    """The lease rules, row by row."""
    state, out = {}, []
    for job, op, us in rows:
        now, g, end = state.get(job, ("hidden", 0, 0))
        if now == "leased" and us >= end:
            g += 1
            out.append((job, "expired", g, end))
            now = "ready"
        if op == "enqueue_immediate":
            now, g = ("ready", 0) if now == "hidden" else (now, g)
        elif op == "claim":
            now, g, end = ("leased", g + 1, us + seconds * 10**6) if now == "ready" else (now, g, end)
        elif now == "leased":
            g += 1
            if op == "renew":
                end = us + seconds * 10**6
            else:
                now = "ready" if op == "retry_now" else "receipt"
                if now == "receipt":
                    out.append((job, "acknowledged", g, us))
        else:
            out.append((job, "already_acked" if op == "acknowledge" and now == "receipt" else "lease_lost", g, us))
        state[job] = (now, g, end)
    return out


def test_stream_equals_fold(spark, small, tmp_path):
    got = leases.run_to_table(leases.lease_expiry(leases.event_stream(spark, small), 6 * 3600, retention_us=10**18), str(tmp_path))
    log = S.transitions(spark, small).select("job_id", "op", F.expr("wall_ns div 1000"), "seq").orderBy("wall_ns", "seq").collect()
    want = _fold([(r[0], r[1], r[2]) for r in log], 6 * 3600)
    rows = [tuple(r) for r in got.select("job_id", "outcome", "generation", "at_us").collect()]
    # a timer may have expired the last lease of a job already
    assert set(want) <= set(rows) and all(r[1] == "expired" for r in set(rows) - set(want)) and len(rows) == len(set(rows))


def test_watermark_outlives_restarts_and_old_clocks(spark, small, tmp_path):
    stream = leases.event_stream(spark, small)
    leases.wall_watermark(stream, f"{tmp_path}/log", f"{tmp_path}/marks", 10_000_000)
    top = leases.stored_watermark(spark, f"{tmp_path}/marks").first()["bucket"]
    old = stream.withColumn("ts", F.col("ts") - F.expr("interval 30 days"))
    leases.wall_watermark(old, f"{tmp_path}/log2", f"{tmp_path}/marks", 10_000_000)
    assert leases.stored_watermark(spark, f"{tmp_path}/marks").first()["bucket"] == top


def test_no_python_in_hot_plans(spark, small):
    for name in ("claim_topk_per_shard", "reap_split", "format_names", "duplicate_ack", "retry_backoff_jitter"):
        plan = P.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan

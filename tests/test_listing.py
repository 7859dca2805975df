"""A tree on disk, listed with stat; the whole audit and its repair; steps of recovery that outlive a session."""

import os

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import audit, recovery, records, stats, tickets
from tidewheel.operators import transitions as X
from tidewheel.plans import flows
from tidewheel.sources import tables as S
from tidewheel.sources.listing import list_tree
from tidewheel.streaming import leases

CONFIG, BOOT = S.CONFIG, "0f" * 16


def test_listing_sees_what_the_reader_cannot(spark, tmp_path):
    from test_queue import _tree

    paths = {}
    for path, data, want in _tree(spark):
        if want is None:
            paths[path] = data
    (ready, data), *_ = [(p, c) for p, c in paths.items() if p.startswith("ready/") and ".o" not in p]
    for path, content in paths.items():
        to = tmp_path / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(content)
    folder = (tmp_path / ready).parent
    os.link(tmp_path / ready, folder / "other.sqj")
    os.symlink("nowhere", folder / (ready.rsplit("/", 1)[1].replace("g0000000000000000", "g0000000000000001")))
    (folder / os.fsdecode(b"\xff\xfe.sqj")).write_bytes(b"")
    files = list_tree(spark, str(tmp_path))
    found = {r["relative_path"].rsplit("/", 1)[1]: r["finding"] for r in audit.fsck(files, CONFIG).collect()}
    assert found[ready.rsplit("/", 1)[1]] == "unexpected_hard_link" and found["other.sqj"] == "filename_parse_failed"
    assert found["<bytes:fffe2e73716a>"] == "invalid_name_encoding" and "non_regular_file" in found.values()
    bad = audit.fsck(files, CONFIG).filter("finding is not null")
    moves = {r["relative_path"].rsplit("/", 1)[1]: (r["finding"], r["reason"]) for r in audit.repair(bad).collect()}
    assert moves[ready.rsplit("/", 1)[1]] == ("quarantined", 9) and moves["other.sqj"] == ("quarantined", 3) and len(moves) == 3
    taken = audit.repair(bad).select("quarantine_id")
    assert {r["finding"] for r in audit.repair(bad, taken).collect()} == {"quarantine_failed"}
    assert audit.exit_code(bad).first()["exit_code"] == 3
    walked = {r["state"]: r["objects"] for r in stats.walk(files.withColumnRenamed("modified_us", "modified")).collect()}
    assert walked["ready"] >= 3


def test_steps_outlive_a_session(spark, small, tmp_path):
    objects = flows._tree(spark, small).filter("shard < 16").cache()
    whole = recovery.by_phase(recovery.plan(objects, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)).agg(F.sum("n")).first()[0]
    done, folder = [], str(tmp_path / "ring")
    for _ in range(60):
        step = recovery.next_step(objects, folder, 30, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)  # reads the position anew
        done += [(r["phase"], r["job_id"]) for r in step.rows.select("phase", "job_id").collect()]
        recovery.commit(step, folder)
        if not step.exhausted:
            break
    assert len(done) == len(set(done)) == whole
    assert recovery.load_position(spark, folder).phase == "reap" and recovery.load_position(spark, str(tmp_path / "new")).step == 0
    lost = recovery.next_step(objects, str(tmp_path / "lost"), 30, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)
    again = recovery.next_step(objects, str(tmp_path / "lost"), 30, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)
    assert lost.rows.select("job_id").collect() == again.rows.select("job_id").collect()  # a step that isn't committed is done again


def test_recovery_twice_changes_nothing(spark, small):
    objects = flows._tree(spark, small)
    after, _ = recovery.recover(objects, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)
    after = after.cache()
    again, report = recovery.recover(after, S.NOW_NS, flows._BOOT, CONFIG, flows.BOOTTIME)
    assert report.count() == 0 and again.exceptAll(after).count() == 0
    seen = recovery.watch(lambda: objects.filter("state = 'temp'"), lambda rows: None, "/tmp/" + os.urandom(6).hex(), 10, lambda: S.NOW_NS, flows._BOOT, CONFIG, 2)
    assert [sum(s.values()) for s in seen] == [10, 10]


def test_folds_do_not_depend_on_chunks(spark, small):
    log = S.transitions(spark, small)
    for f in (X.accepted, X.with_source):
        want = sorted(map(tuple, f(log, 10**6).collect()), key=repr)
        for chunk in (1, 2, 7):
            assert sorted(map(tuple, f(log, chunk).collect()), key=repr) == want


def test_state_is_dropped_after_the_retention(spark, small, tmp_path):
    stream = leases.lease_expiry(leases.event_stream(spark, small), 3600, retention_us=0, bucket_us=1)
    rows = leases.run_to_table(stream, str(tmp_path / "a")).groupBy("outcome").count().collect()
    kept = leases.run_to_table(leases.lease_expiry(leases.event_stream(spark, small), 3600, retention_us=10**18), str(tmp_path / "b")).groupBy("outcome").count().collect()
    assert {r["outcome"] for r in rows} <= {"expired", "acknowledged", "already_acked", "lease_lost"} and {r["outcome"] for r in kept} <= {"expired", "acknowledged", "already_acked", "lease_lost"}
    more = leases.run_to_table(stream, str(tmp_path / "a")).groupBy("outcome").count().collect()
    assert sorted(more) == sorted(rows)  # a second run of the same stream reads nothing again


def test_load_and_tickets(spark):
    fmt = __import__("tidewheel.functions.binary", fromlist=["x"]).encode_format(
        queue_id=F.lit(CONFIG.queue_id), created_at_unix_ns=F.lit(0), shard_count=F.lit(128), lease_bucket_width_ns=F.lit(10**9), delayed_bucket_width_ns=F.lit(10**9),
        terminal_bucket_width_ns=F.lit(3600 * 10**9), max_payload_length=F.lit(1000),
    )
    one = spark.range(1).select(fmt.alias("content"))
    got = records.load(one)
    assert (got.shard_count, got.lease_bucket_width_ns, got.max_payload_length) == (128, 10**9, 1000)
    with pytest.raises(ValueError):
        records.load(spark.range(1).select(F.lit(b"x").alias("content")))
    t = spark.createDataFrame([("{",), ("",), (None,), ("[]",)], "ticket string")
    assert {r["problem"] for r in tickets.parse(t, CONFIG).collect()} == {"json"}

"""Named queries over recovery and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import recovery
from tidewheel.plans.queries import _BOOT, DAY, HOUR, JOBS, LOG, WIDTH, query
from tidewheel.runtime import shared_folder
from tidewheel.sources import tables as S
from tidewheel.sources.tables import CONFIG, NOW_NS
from tidewheel.streaming import leases

BOOTTIME = 10**15
LEASE_S = 6 * 3600


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """One object for every job, its state by number: leases, delayed and temporary objects, receipts (some full and verified), ready ones."""
    j, k = S.jobs(spark, d), F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(s) for s in ("leased", "delayed", "temp", "receipt", "ready")]), (k % 5 + 1).cast("int"))
    bucket = F.when(state == "receipt", F.expr(f"created_ns div {HOUR}")).when(state == "delayed", F.expr(f"(not_before_ns + {WIDTH - 1}) div {WIDTH}")).when(state == "leased", F.expr(f"not_before_ns div {WIDTH}"))
    return j.select(
        "job_id", "shard", state.alias("state"), F.lit(1).cast("long").alias("generation"), (k % 4 + 1).cast("long").alias("attempt"), "maximum_attempts", bucket.cast("long").alias("bucket"),
        F.when(k % 2 == 0, F.lit(_BOOT)).otherwise(F.lit("ff" * 16)).alias("boot_id"), F.col("not_before_ns").alias("deadline_ns"), (F.lit(BOOTTIME) - (k % 50) * (DAY // 10)).cast("long").alias("created_boottime_ns"),
        F.when(k % 3 == 0, "full").otherwise("compact").alias("receipt_kind"), (k % 7 != 0).alias("verified"), F.lit(None).cast("int").alias("reason"),
    )


_TREE = f"""{JOBS}, t AS (SELECT job_id, shard, o_orderkey AS k, maximum_attempts, o_orderkey % 4 + 1 AS attempt, ['leased', 'delayed', 'temp', 'receipt', 'ready'][o_orderkey % 5 + 1] AS state,
  o_orderkey % 2 = 0 AS here, not_before_ns, created_ns, (o_orderkey % 50) * {DAY} // 10 AS age FROM jobs),
a AS (SELECT *, CASE state WHEN 'receipt' THEN created_ns // {HOUR} WHEN 'delayed' THEN (not_before_ns + {WIDTH - 1}) // {WIDTH} WHEN 'leased' THEN not_before_ns // {WIDTH} END AS bucket,
  state = 'leased' AND (NOT here OR not_before_ns <= {NOW_NS}) AS reap, state = 'delayed' AND (not_before_ns + {WIDTH - 1}) // {WIDTH} <= {NOW_NS // WIDTH} AS promote,
  state = 'temp' AND (NOT here OR age > {CONFIG.temporary_ttl_ns}) AS temp, state = 'receipt' AND k % 3 = 0 AND k % 7 <> 0 AS compact,
  state = 'receipt' AND (created_ns // {HOUR} + 1) * {HOUR} + {CONFIG.receipt_retention_ns} <= {NOW_NS} AS del FROM t)"""


def _planned(spark, d):
    return recovery.plan(_tree(spark, d), NOW_NS, _BOOT, CONFIG, BOOTTIME)


@query(f"""WITH {_TREE} SELECT 'reap' AS phase, CASE WHEN attempt < maximum_attempts THEN 'ready' ELSE 'dead' END AS state, count(*) AS n FROM a WHERE reap GROUP BY 2
UNION ALL SELECT 'promote', 'ready', count(*) FROM a WHERE promote HAVING count(*) > 0 UNION ALL SELECT 'temp', 'temp', count(*) FROM a WHERE temp HAVING count(*) > 0
UNION ALL SELECT 'compact', 'receipt', count(*) FROM a WHERE compact HAVING count(*) > 0 UNION ALL SELECT 'delete', 'receipt', count(*) FROM a WHERE del HAVING count(*) > 0""")
def recovery_phases(spark, d):
    return recovery.recover(_tree(spark, d), NOW_NS, _BOOT, CONFIG, BOOTTIME)[1]


@query(f"""WITH {_TREE}, r AS (SELECT bucket, shard, min(CASE WHEN del THEN 1 ELSE 0 END) AS gone FROM a WHERE state = 'receipt' GROUP BY 1, 2), e AS (SELECT bucket, min(gone) AS g, sum(gone) AS s FROM r GROUP BY 1)
SELECT CAST(sum(reap::INT + promote::INT + temp::INT + compact::INT + del::INT) AS BIGINT) AS operations_attempted, count(*) FILTER (WHERE reap AND attempt < maximum_attempts) AS leases_reaped,
count(*) FILTER (WHERE reap AND attempt >= maximum_attempts) AS leases_to_dead, count(*) FILTER (WHERE promote) AS delayed_promoted, count(*) FILTER (WHERE temp) AS temp_files_deleted,
count(*) FILTER (WHERE compact) AS receipts_compacted, count(*) FILTER (WHERE del) AS receipts_expired, (SELECT CAST(coalesce(sum(g), 0) AS BIGINT) FROM e) AS buckets_removed,
(SELECT CAST(coalesce(sum(s), 0) AS BIGINT) FROM e) AS shards_removed FROM a""")
def recovery_counters(spark, d):
    return recovery.counters(_planned(spark, d))


@query(f"""WITH {_TREE} SELECT job_id, CASE WHEN reap AND attempt < maximum_attempts OR promote THEN 'ready' WHEN reap THEN 'dead' ELSE state END AS state,
CASE WHEN reap OR promote THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS generation, CASE WHEN reap AND attempt >= maximum_attempts THEN 4 END AS reason,
CASE WHEN compact OR k % 3 <> 0 THEN 'compact' ELSE 'full' END AS receipt_kind FROM a WHERE NOT temp AND NOT del""")
def recovered_snapshot(spark, d):
    after = recovery.recover(_tree(spark, d), NOW_NS, _BOOT, CONFIG, BOOTTIME)[0]
    return after.select("job_id", "state", "generation", "reason", "receipt_kind")


@query(f"WITH {_TREE} SELECT job_id, state, 'quarantine' AS problem, md5('quarantine:' || job_id) AS quarantine_id FROM a WHERE attempt > maximum_attempts")
def recovery_problems(spark, d):
    return recovery.problems(_planned(spark, d), CONFIG)


@query(f"""WITH {_TREE}, o AS (SELECT job_id, p, row_number() OVER (ORDER BY p, coalesce(bucket, -1), shard, job_id) AS i FROM (
  SELECT job_id, bucket, shard, 1 AS p FROM a WHERE reap UNION ALL SELECT job_id, bucket, shard, 2 FROM a WHERE promote UNION ALL SELECT job_id, bucket, shard, 3 FROM a WHERE temp
  UNION ALL SELECT job_id, bucket, shard, 4 FROM a WHERE compact UNION ALL SELECT job_id, bucket, shard, 5 FROM a WHERE del))
SELECT job_id, ['reap', 'promote', 'temp', 'compact', 'delete'][p] AS phase, CAST((i - 1) // 100 AS INTEGER) AS step FROM o WHERE i <= 400""")
def recovery_steps(spark, d):
    """Four steps of 100 operations; phase and cursor are kept in a folder and read again before each."""
    folder, out = f"{shared_folder(spark)}/{uuid.uuid4().hex}", None
    objects = _tree(spark, d)
    for k in range(4):
        now = recovery.next_step(objects, folder, 100, NOW_NS, _BOOT, CONFIG, BOOTTIME)
        rows = now.rows.select("job_id", "phase", F.lit(k).alias("step"))
        out = rows if out is None else out.union(rows)
        recovery.commit(now, folder)
        if not now.exhausted:
            break
    return out


# -- streams

_LEASE_US = LEASE_S * 1_000_000


@query(f"""WITH RECURSIVE {LOG}, f AS (
  SELECT job_id, CAST(-1 AS BIGINT) AS i, 'hidden' AS state, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS deadline, CAST(0 AS BIGINT) AS us, [] :: STRUCT(outcome VARCHAR, generation BIGINT, at_us BIGINT)[] AS said FROM log WHERE generation = 0
  UNION ALL
  SELECT job_id, i, CASE WHEN op = 'enqueue_immediate' AND s = 'hidden' THEN 'ready' WHEN op = 'claim' AND s = 'ready' THEN 'leased' WHEN op = 'retry_now' AND s = 'leased' THEN 'ready' WHEN op = 'acknowledge' AND s = 'leased' THEN 'receipt' ELSE s END,
    CASE WHEN op = 'enqueue_immediate' AND s = 'hidden' THEN 0 WHEN op = 'claim' AND s = 'ready' OR op IN ('renew', 'retry_now', 'acknowledge') AND s = 'leased' THEN h + 1 ELSE h END,
    CASE WHEN op = 'claim' AND s = 'ready' OR op = 'renew' AND s = 'leased' THEN us + {_LEASE_US} ELSE deadline END, us,
    list_concat(CASE WHEN over THEN [{{'outcome': 'expired', 'generation': h, 'at_us': deadline}}] ELSE [] END,
      CASE WHEN op = 'acknowledge' AND s = 'leased' THEN [{{'outcome': 'acknowledged', 'generation': h + 1, 'at_us': us}}] WHEN op = 'acknowledge' AND s = 'receipt' THEN [{{'outcome': 'already_acked', 'generation': h, 'at_us': us}}]
           WHEN op IN ('renew', 'retry_now', 'acknowledge') AND s <> 'leased' THEN [{{'outcome': 'lease_lost', 'generation': h, 'at_us': us}}] ELSE [] END)
  FROM (SELECT l.job_id, l.generation AS i, l.op, l.wall_ns // 1000 AS us, f.deadline, f.state = 'leased' AND l.wall_ns // 1000 >= f.deadline AS over,
          CASE WHEN f.state = 'leased' AND l.wall_ns // 1000 >= f.deadline THEN 'ready' ELSE f.state END AS s, CASE WHEN f.state = 'leased' AND l.wall_ns // 1000 >= f.deadline THEN f.g + 1 ELSE f.g END AS h
        FROM f JOIN log l ON l.job_id = f.job_id AND l.generation = f.i + 1))
SELECT job_id, x.outcome AS outcome, x.generation AS generation, x.at_us AS at_us FROM (SELECT job_id, unnest(said) AS x FROM f) WHERE x.outcome <> 'expired'""")
def streaming_outcomes(spark, d):
    """What the lease stream says about operations.  (When the stream's end comes decides which last leases a timer still expires; see streaming_lease_expiry.)"""
    got = leases.run_to_table(leases.lease_expiry(leases.event_stream(spark, d), LEASE_S), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return got.filter("outcome <> 'expired'")


@query()
def streaming_lease_expiry(spark, d):
    return leases.run_to_table(leases.lease_expiry(leases.event_stream(spark, d), LEASE_S), f"{shared_folder(spark)}/{uuid.uuid4().hex}")


@query(f"SELECT max(epoch_us(ts)) // 10000000 AS bucket FROM events")
def streaming_watermark(spark, d):
    """The stored bucket after two runs over the same stream and one from an older clock: it is the highest there was."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    leases.wall_watermark(leases.event_stream(spark, d), f"{folder}/log", f"{folder}/marks", 10_000_000)
    again = leases.event_stream(spark, d).withColumn("ts", F.col("ts") - F.expr("interval 90 days"))
    leases.wall_watermark(again, f"{folder}/log2", f"{folder}/marks", 10_000_000)
    return leases.stored_watermark(spark, f"{folder}/marks")


@query("SELECT md5(CAST(user_id AS VARCHAR)) AS job_id, event_id AS seq, CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'retry_now' ELSE 'acknowledge' END AS op FROM events WHERE event_type = 'view'")
def worker_loop(spark, d):
    """A stream of claims given to a handler; a job is acknowledged, or retried where the handler fails."""
    stream = leases.raw_events(spark, d).filter("event_type = 'view'").select(S.job_key(F.col("user_id")).alias("job_id"), F.col("event_id").alias("seq"), "value")
    done = leases.work(stream, lambda value: int(value) % 4 != 0, "value")
    return leases.run_to_table(done, f"{shared_folder(spark)}/{uuid.uuid4().hex}")

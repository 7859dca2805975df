"""Named queries over the projections, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import cbor
from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.operators import audit, lookup, recovery, stats
from tidewheel.operators import transitions as X
from tidewheel.schema import DEAD_REASONS, HASH_DOMAIN, METRIC_PREFIX, PROTOCOL, STATES
from tidewheel.sources import tables as S
from tidewheel.sources.tables import BOOT_ID, CONFIG, EVENTS_NOW_NS, NOW_NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LEASE_NS = 30 * 10**9
HOUR, DAY = CONFIG.terminal_bucket_width_ns, 86_400 * 10**9
WIDTH = CONFIG.delayed_bucket_width_ns
FLOOR_BUCKET = NOW_NS // HOUR


def _queue():
    return F.lit(CONFIG.queue_id)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- SQL of the projections


def _domain(label: str) -> str:
    return f"unhex('{(HASH_DOMAIN + '-' + label).encode().hex()}00{CONFIG.queue_id}')"


def _shard_sql(job: str) -> str:
    return f"CAST(('0x' || substr(sha256({_domain('shard')} || unhex({job})), 1, 8))::UBIGINT % {CONFIG.shard_count} AS INTEGER)"


def _hex_sql(x: str, digits: int) -> str:
    return f"printf('%0{digits}x', {x})"


def _tag_sql(context: str) -> str:
    return f"substr(sha256({_domain('name')} || encode({context})), 1, 16)"


JOBS = f"""jobs AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, md5(CAST(o_orderkey AS VARCHAR)) AS job_id,
    epoch_us(o_orderdate) * 1000 AS created_ns, 1 + o_orderkey % 5 AS maximum_attempts,
    epoch_us(o_orderdate) * 1000 + (o_orderkey % 7) * 3600000000000 AS not_before_ns,
    {_shard_sql("md5(CAST(o_orderkey AS VARCHAR))")} AS shard
  FROM orders)"""
ATTEMPTS = JOBS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS attempt FROM lineitem
), attempts AS (
  SELECT o_orderkey, attempt, CASE l_returnflag WHEN 'A' THEN 'ack' WHEN 'R' THEN 'retry' ELSE 'expire' END AS outcome,
    epoch_us(l_shipdate) * 1000 AS deadline_ns, md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(attempt AS VARCHAR)) AS token,
    md5(CAST(l_suppkey % 2 AS VARCHAR)) AS boot_id, job_id, created_ns, maximum_attempts, shard
  FROM numbered JOIN jobs ON l_orderkey = o_orderkey)"""
_OPS = " ".join(f"WHEN '{k}' THEN '{op}'" for k, (op, _) in S.EVENT_OPS.items())
_TO = " ".join(f"WHEN '{k}' THEN '{to}'" for k, (_, to) in S.EVENT_OPS.items())
LOG = f"""log AS (
  SELECT event_id AS seq, user_id, md5(CAST(user_id AS VARCHAR)) AS job_id, CASE event_type {_OPS} END AS op, CASE event_type {_TO} END AS to_state,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS generation, epoch_us(ts) * 1000 AS wall_ns
  FROM events)"""
LATEST = LOG + """, latest AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1)"""
_EDGES = ", ".join(f"('{op}', '{s}')" for op, s, *_ in PROTOCOL)
_DOMAIN = ", ".join(f"('{s}')" for s in STATES)


def _stats_sql(state: str) -> str:
    return f"""WITH {LATEST}, d(state) AS (VALUES {_DOMAIN}), g AS (
  SELECT {state} AS state, count(*) AS n, min(wall_ns) AS oldest FROM latest GROUP BY 1)
SELECT d.state, coalesce(n, 0) AS objects, CAST(CASE WHEN oldest IS NOT NULL THEN greatest({EVENTS_NOW_NS} - oldest, 0) END // 1000000000 AS BIGINT) AS oldest_age_seconds
FROM d LEFT JOIN g ON d.state = g.state"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    return S.current(spark, d)


# -- statistics


@query(_stats_sql("to_state"))
def stats_by_state(spark, d):
    return stats.by_state(_current(spark, d), EVENTS_NOW_NS)


@query(_stats_sql("CASE to_state WHEN 'leased' THEN 'ready' ELSE to_state END"))
def stats_by_directory(spark, d):
    return stats.by_directory(_current(spark, d), EVENTS_NOW_NS)


@query(f"WITH {JOBS} SELECT shard, count(*) AS objects, min(created_ns) AS oldest_ns, CAST(sum(maximum_attempts) AS BIGINT) AS attempts FROM jobs GROUP BY shard")
def stats_by_shard(spark, d):
    return S.jobs(spark, d).groupBy("shard").agg(F.count("*").alias("objects"), F.min("created_ns").alias("oldest_ns"), F.sum("maximum_attempts").alias("attempts"))


@query(f"WITH {LATEST} SELECT CAST(({EVENTS_NOW_NS} - min(wall_ns)) // 1000000000 AS BIGINT) AS oldest_age_seconds, count(*) AS objects FROM latest")
def oldest_age(spark, d):
    one = _current(spark, d).agg(F.min("wall_ns").alias("m"), F.count("*").alias("objects"))
    return one.select(F.expr(f"({EVENTS_NOW_NS} - m) div 1000000000").alias("oldest_age_seconds"), "objects")


@query("SELECT CASE event_type " + _OPS + " END AS op, count(*) AS n, min(epoch_us(ts) * 1000) AS first_ns FROM events GROUP BY 1")
def transition_counts(spark, d):
    e = S.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(S.micros(F.col("ts")) * 1000).alias("first_ns"))
    op = F.lit(None).cast("string")
    for kind, (name, _) in S.EVENT_OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
    return e.select(op.alias("op"), "n", "first_ns")


@query(f"""WITH {LATEST}, g AS (SELECT to_state AS state, count(*) AS n, greatest({EVENTS_NOW_NS} - min(wall_ns), 0) // 1000000000 AS age FROM latest GROUP BY 1),
d(state) AS (VALUES {_DOMAIN}), s AS (SELECT d.state, coalesce(n, 0) AS n, CAST(age AS BIGINT) AS age FROM d LEFT JOIN g ON d.state = g.state)
SELECT '# TYPE {METRIC_PREFIX}_' || state || '_objects gauge' AS line FROM s
UNION ALL SELECT '{METRIC_PREFIX}_' || state || '_objects ' || n FROM s
UNION ALL SELECT '# TYPE {METRIC_PREFIX}_' || state || '_oldest_age_seconds gauge' FROM s WHERE age IS NOT NULL
UNION ALL SELECT '{METRIC_PREFIX}_' || state || '_oldest_age_seconds ' || age FROM s WHERE age IS NOT NULL""")
def prometheus_lines(spark, d):
    return stats.prometheus(stats_by_state(spark, d))


@query("""WITH g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value FROM g WHERE i = least(CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT), n - 1)""")
def latency_p99(spark, d):
    return stats.exact_quantile(S.table(spark, d, "events").select("event_type", "value"), "event_type", "value", 0.99)


@query(f"""WITH {JOBS} SELECT count(DISTINCT shard) AS directories, count(*) AS entries, CAST(sum(92) AS BIGINT) AS name_bytes FROM jobs""")
def scan_stats(spark, d):
    return stats.scan_stats(_ready_paths(spark, d))


def _base(generation=None, attempt=None):
    return N.base_name(F.col("job_id"), generation or F.lit(0), attempt or F.lit(0), F.col("maximum_attempts"))


def _ready_paths(spark, d):
    name = N.ready_name(_queue(), F.col("shard"), _base())
    return S.jobs(spark, d).withColumn("relative_path", F.concat(F.lit("ready/"), N.shard_dir(F.col("shard")), F.lit("/"), name))


# -- the log


@query(f"""WITH {LOG}, e AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY job_id ORDER BY generation), 'hidden') AS from_state FROM log),
edges(op, s) AS (VALUES {_EDGES})
SELECT e.op, CAST(sum(CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_legal, CAST(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_illegal
FROM e LEFT JOIN edges ON e.op = edges.op AND e.from_state = edges.s GROUP BY e.op""")
def illegal_transitions(spark, d):
    log = X.with_source(S.transitions(spark, d))
    return log.groupBy("op").agg(F.count_if("legal").alias("n_legal"), F.count_if(~F.col("legal")).alias("n_illegal"))


@query(f"WITH {LATEST} SELECT job_id, op, to_state AS state, generation, wall_ns FROM latest")
def latest_state(spark, d):
    return _current(spark, d).select("job_id", "op", "state", "generation", "wall_ns")


@query(f"""WITH RECURSIVE {LOG}, edges(op, s) AS (VALUES {_EDGES}), f AS (
  SELECT job_id, CAST(-1 AS BIGINT) AS generation, 'hidden' AS state, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected FROM log WHERE generation = 0
  UNION ALL
  SELECT l.job_id, l.generation, CASE WHEN e.op IS NOT NULL THEN l.to_state ELSE f.state END,
    f.accepted + CASE WHEN e.op IS NOT NULL THEN 1 ELSE 0 END, f.rejected + CASE WHEN e.op IS NULL THEN 1 ELSE 0 END
  FROM f JOIN log l ON l.job_id = f.job_id AND l.generation = f.generation + 1 LEFT JOIN edges e ON e.op = l.op AND e.s = f.state)
SELECT job_id, state, accepted, rejected FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1""")
def accepted_state(spark, d):
    return X.accepted(S.transitions(spark, d))


@query("""WITH late AS (SELECT event_id AS seq, epoch_us(ts) * 1000 - CASE WHEN event_id % 17 = 0 THEN 7200000000000 ELSE 0 END AS wall_ns FROM events)
SELECT seq, wall_ns, max(wall_ns) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor FROM late""")
def wall_floor_running(spark, d):
    late = F.when(F.col("event_id") % 17 == 0, F.lit(7_200_000_000_000)).otherwise(F.lit(0))
    e = S.table(spark, d, "events").select(F.col("event_id").alias("seq"), (S.micros(F.col("ts")) * 1000 - late).alias("wall_ns"))
    return X.running_max(e, "wall_ns", "seq")


# -- transitions


@query(f"""WITH {JOBS} SELECT job_id, shard, CASE WHEN not_before_ns > {NOW_NS} THEN 'delayed' ELSE 'ready' END AS state,
CASE WHEN not_before_ns > {NOW_NS} THEN 'enqueue_delayed' ELSE 'enqueue_immediate' END AS op,
CASE WHEN not_before_ns > {NOW_NS} THEN (not_before_ns + {WIDTH - 1}) // {WIDTH} END AS bucket FROM jobs""")
def enqueue_routing(spark, d):
    return X.route_enqueued(S.jobs(spark, d), NOW_NS, CONFIG).select("job_id", "shard", "state", "op", "bucket")


@query(f"""WITH {JOBS} SELECT job_id, 'ready' AS state, CAST(1 AS BIGINT) AS generation FROM jobs
WHERE o_orderkey % 7 > 0 AND (not_before_ns + {WIDTH - 1}) // {WIDTH} <= {NOW_NS // WIDTH}""")
def promote_due(spark, d):
    delayed = S.jobs(spark, d).filter("o_orderkey % 7 > 0").withColumns(
        {"bucket": K.bucket_ceil(F.col("not_before_ns"), F.lit(WIDTH)).cast("long"), "generation": F.lit(0).cast("long"), "attempt": F.lit(0).cast("long")}
    )
    return X.promote(delayed, NOW_NS, CONFIG).select("job_id", "state", "generation")


def _claimed(spark, d, per_shard=3):
    ready = X.route_enqueued(S.jobs(spark, d), NOW_NS, CONFIG).filter("state = 'ready'")
    return X.claim(ready, per_shard, NOW_NS, 10**12, LEASE_NS, BOOT_ID, CONFIG)


@query(f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY created_ns, job_id) AS k FROM jobs WHERE not_before_ns <= {NOW_NS})
SELECT job_id, shard, CAST(k AS INTEGER) AS rank, CAST(1 AS BIGINT) AS generation, CAST(1 AS BIGINT) AS attempt, md5(job_id || ':1') AS token,
CAST({NOW_NS + LEASE_NS} AS BIGINT) AS wall_deadline_ns, CAST({(10**12 + LEASE_NS) // CONFIG.lease_bucket_width_ns} AS BIGINT) AS bucket FROM r WHERE k <= 3""")
def claim_topk_per_shard(spark, d):
    c = _claimed(spark, d)
    return c.select("job_id", "shard", "rank", "generation", "attempt", "token", F.col("wall_deadline_ns").cast("long").alias("wall_deadline_ns"), F.col("bucket").cast("long").alias("bucket"))


_RETRIED = """, retried AS (SELECT job_id, shard, max(maximum_attempts) AS maximum_attempts, least(count(*), max(maximum_attempts)) AS attempt,
  2 * least(count(*), max(maximum_attempts)) AS generation, max(deadline_ns) AS deadline_ns, min(created_ns) AS created_ns FROM attempts GROUP BY job_id, shard)"""


def _retried(spark, d):
    """Jobs back in ready after their attempts: two transitions for each."""
    g = S.attempts(spark, d).groupBy("job_id", "shard").agg(
        F.max("maximum_attempts").alias("maximum_attempts"), F.count("*").alias("n"), F.max("deadline_ns").alias("deadline_ns"), F.min("created_ns").alias("created_ns")
    )
    return g.withColumn("attempt", F.least("n", "maximum_attempts")).withColumn("generation", 2 * F.col("attempt")).drop("n")


@query(f"WITH {ATTEMPTS}{_RETRIED} SELECT job_id, 'dead' AS state, 4 AS reason, generation + 1 AS generation, attempt, CAST({FLOOR_BUCKET} AS BIGINT) AS bucket FROM retried WHERE attempt >= maximum_attempts")
def exhausted_to_dead(spark, d):
    dead = X.bury_exhausted(_retried(spark, d), NOW_NS, CONFIG)
    return dead.select("job_id", "state", "reason", "generation", "attempt", F.col("bucket").cast("long").alias("bucket"))


@query(f"""WITH {LOG} SELECT job_id, generation + 1 AS generation, wall_ns + {LEASE_NS} AS wall_deadline_ns, (wall_ns + {LEASE_NS}) // {CONFIG.lease_bucket_width_ns} AS bucket
FROM log WHERE op = 'renew'""")
def renew_effect(spark, d):
    log = S.transitions(spark, d).filter("op = 'renew'")
    return X.renew(log, F.col("wall_ns"), LEASE_NS, CONFIG).select("job_id", "generation", "wall_deadline_ns", "bucket")


def _receipts(spark, d):
    a = S.attempts(spark, d).filter("outcome = 'ack' and attempt <= maximum_attempts").withColumn("generation", 2 * F.col("attempt") - 1)
    return X.acknowledge(a, F.col("deadline_ns"), CONFIG)


RECEIPTS = ATTEMPTS + f""", receipts AS (SELECT job_id, shard, attempt, token, maximum_attempts, 2 * attempt AS generation, deadline_ns, deadline_ns // {HOUR} AS bucket FROM attempts
  WHERE outcome = 'ack' AND attempt <= maximum_attempts)"""


@query(f"WITH {RECEIPTS} SELECT job_id, attempt, generation, token, bucket FROM receipts")
def ack_receipts(spark, d):
    return _receipts(spark, d).select("job_id", "attempt", "generation", "token", "bucket")


@query(f"""WITH {ATTEMPTS} SELECT job_id, attempt, CASE WHEN attempt >= maximum_attempts THEN 'bury' WHEN attempt % 2 = 0 THEN 'retry_later' ELSE 'retry_now' END AS effective_op,
CASE WHEN attempt >= maximum_attempts THEN 'dead' WHEN attempt % 2 = 0 THEN 'delayed' ELSE 'ready' END AS state,
CASE WHEN attempt >= maximum_attempts THEN deadline_ns // {HOUR} WHEN attempt % 2 = 0 THEN (deadline_ns + 60000000000 + {WIDTH - 1}) // {WIDTH} END AS bucket
FROM attempts WHERE outcome = 'retry'""")
def retry_now(spark, d):
    a = S.attempts(spark, d).filter("outcome = 'retry'").withColumn("generation", 2 * F.col("attempt") - 1)
    until = F.col("deadline_ns") + F.when(F.col("attempt") % 2 == 0, F.lit(60 * 10**9)).otherwise(F.lit(0))
    return X.retry(a, F.col("deadline_ns"), until, CONFIG).select("job_id", "attempt", "effective_op", "state", "bucket")


@query(f"WITH {ATTEMPTS} SELECT attempt, count(*) AS n, least(300000, 1000 * CAST(pow(2, attempt - 1) AS BIGINT)) AS delay_ms FROM attempts GROUP BY attempt")
def retry_backoff_nojitter(spark, d):
    a = S.attempts(spark, d).groupBy("attempt").agg(F.count("*").alias("n"))
    return a.withColumn("delay_ms", K.retry_ceiling(F.lit(1000), F.lit(300_000), F.col("attempt")).cast("long"))


_JITTER = f"""('0x' || substr(sha256({_domain('jitter')} || unhex(job_id) || unhex({_hex_sql('attempt', 8)}) || unhex('00000000')), 1, 16))::UBIGINT"""


@query(f"""WITH {ATTEMPTS}, c AS (SELECT job_id, attempt, least(60000, 1000 * CAST(pow(2, attempt - 1) AS BIGINT)) AS c, {_JITTER} AS x FROM attempts)
SELECT job_id, attempt, CAST((c + 1) // 2 + CAST(x % CAST(c - (c + 1) // 2 + 1 AS UBIGINT) AS BIGINT) AS BIGINT) AS delay_ms FROM c""")
def retry_backoff_jitter(spark, d):
    a = S.attempts(spark, d)
    return a.select("job_id", "attempt", K.retry_delay(_queue(), F.col("job_id"), F.lit(1000), F.lit(60_000), F.col("attempt")).cast("long").alias("delay_ms"))


@query(f"WITH {ATTEMPTS} SELECT job_id, attempt, deadline_ns + 1000000 * least(300000, 1000 * CAST(pow(2, attempt - 1) AS BIGINT)) AS retry_at_ns FROM attempts WHERE outcome = 'expire'")
def retry_deadline(spark, d):
    a = S.attempts(spark, d).filter("outcome = 'expire'")
    delay = K.checked_mul(K.retry_ceiling(F.lit(1000), F.lit(300_000), F.col("attempt")), F.lit(1_000_000))
    return a.select("job_id", "attempt", K.retry_deadline(F.col("deadline_ns"), delay).cast("long").alias("retry_at_ns"))


_REASON = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1"


@query(f"""WITH {JOBS}, r(code, name) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in DEAD_REASONS.items())}), j AS (SELECT {_REASON} AS code FROM jobs)
SELECT r.code AS reason, r.name AS reason_name, count(*) AS n FROM j JOIN r ON j.code = r.code GROUP BY 1, 2""")
def bury_by_reason(spark, d):
    leased = S.jobs(spark, d).withColumn("generation", F.lit(1).cast("long"))
    dead = X.to_dead(leased, F.expr("cast(substr(o_orderpriority, 1, 1) as int) - 1"), NOW_NS, CONFIG).groupBy("reason").agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(x) for k in DEAD_REASONS.items() for x in k])
    return dead.select("reason", F.try_element_at(names, F.col("reason")).alias("reason_name"), "n").filter("reason_name is not null")


_BOOT = "cfcd208495d565ef66e7dff9f98764da"  # md5 of 0


@query(f"""WITH {ATTEMPTS} SELECT job_id, attempt, boot_id <> '{_BOOT}' AS other_boot FROM attempts WHERE boot_id <> '{_BOOT}' OR deadline_ns <= {NOW_NS}""")
def lease_expired(spark, d):
    a = S.attempts(spark, d).filter(X.expired(NOW_NS, _BOOT))
    return a.select("job_id", "attempt", (F.col("boot_id") != _BOOT).alias("other_boot"))


@query(f"""WITH {ATTEMPTS} SELECT job_id, attempt, CASE WHEN attempt < maximum_attempts THEN 'reap_expired_to_ready' ELSE 'reap_expired_to_dead' END AS op,
CASE WHEN attempt < maximum_attempts THEN 'ready' ELSE 'dead' END AS state, 2 * attempt AS generation, CASE WHEN attempt >= maximum_attempts THEN 4 END AS reason
FROM attempts WHERE outcome = 'expire' AND (boot_id <> '{_BOOT}' OR deadline_ns <= {NOW_NS})""")
def reap_split(spark, d):
    a = S.attempts(spark, d).filter("outcome = 'expire'").withColumn("generation", 2 * F.col("attempt") - 1)
    return X.reap(a, NOW_NS, _BOOT).select("job_id", "attempt", "op", "state", "generation", "reason")


@query(f"WITH {RECEIPTS} SELECT (bucket + 1) * {HOUR} + {CONFIG.receipt_retention_ns} <= {NOW_NS} AS over, count(*) AS n FROM receipts GROUP BY 1")
def receipt_retention(spark, d):
    return _receipts(spark, d).groupBy(X.retention_over(NOW_NS, CONFIG).alias("over")).agg(F.count("*").alias("n"))


@query("""WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, CAST(128 AS BIGINT) AS size, CAST(strlen(text) AS BIGINT) AS freed FROM documents
WHERE NOT (doc_id IN (SELECT doc_id FROM bad) AND text <> reverse(text))""")
def receipt_compaction(spark, d):
    p = S.corrupted(spark, d).select(
        "job_id", F.lit("full").alias("receipt_kind"), (K.payload_digest(F.col("payload")) == F.col("stored_digest")).alias("verified"), F.octet_length("payload").cast("long").alias("freed")
    )
    return X.compact(p).select("job_id", "size", "freed")


@query(f"SELECT p_partkey, p_size % 2 = 1 AS other_boot FROM part WHERE p_size % 2 = 1 OR {10**15} - p_partkey * 1000000000000 > {CONFIG.temporary_ttl_ns}")
def temp_cleanup(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 1).alias("other_boot"))
    p = p.withColumns({"boot_id": F.when(F.col("other_boot"), "ff" * 16).otherwise(BOOT_ID), "created_boottime_ns": F.col("p_partkey") * 10**12})
    return p.filter(X.temp_deletable(10**15, BOOT_ID, CONFIG)).select("p_partkey", "other_boot")


@query(f"WITH {JOBS} SELECT job_id AS provenance, md5('requeue:' || job_id) AS job_id, 'ready' AS state, CAST(0 AS BIGINT) AS generation FROM jobs WHERE o_orderstatus = 'F'")
def requeue_dead(spark, d):
    dead = S.jobs(spark, d).filter("o_orderstatus = 'F'").withColumns({"state": F.lit("dead"), "reason": F.lit(1)})
    return X.requeue(dead).select("provenance", "job_id", "state", "generation")


@query(f"""WITH {JOBS}, bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT md5('quarantine:' || md5(CAST(doc_id AS VARCHAR))) AS quarantine_id, 2 AS reason, 'q' || md5('quarantine:' || md5(CAST(doc_id AS VARCHAR))) || '.x0002.raw' AS name
FROM documents WHERE doc_id IN (SELECT doc_id FROM bad) AND text <> reverse(text)""")
def quarantine_corrupt(spark, d):
    bad = S.corrupted(spark, d).filter(K.payload_digest(F.col("payload")) != F.col("stored_digest"))
    return X.quarantine(bad, F.lit(2)).select("quarantine_id", "reason", N.quarantine_name(F.col("quarantine_id"), F.col("reason")).alias("name"))


@query(f"WITH {JOBS} SELECT o_orderstatus AS status, count(*) AS n FROM jobs WHERE shard >= 8 GROUP BY 1")
def remove_dead(spark, d):
    j = S.jobs(spark, d)
    return X.remove(j, j.filter("shard < 8")).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


# -- kernels


@query(f"""SELECT event_id, (epoch_us(ts) * 1000) // {WIDTH} AS floor_bucket, (epoch_us(ts) * 1000 + {WIDTH - 1}) // {WIDTH} AS ceil_bucket,
(epoch_us(ts) * 1000) // {HOUR} * {HOUR} AS start_ns, ((epoch_us(ts) * 1000) // {HOUR} + 1) * {HOUR} AS end_ns FROM events""")
def bucket_floor_ceil(spark, d):
    e = S.table(spark, d, "events").select("event_id", (S.micros(F.col("ts")) * 1000).alias("ns"))
    hour = K.bucket_floor(F.col("ns"), F.lit(HOUR))
    return e.select(
        "event_id", K.bucket_floor(F.col("ns"), F.lit(WIDTH)).cast("long").alias("floor_bucket"), K.bucket_ceil(F.col("ns"), F.lit(WIDTH)).cast("long").alias("ceil_bucket"),
        K.bucket_start(hour, F.lit(HOUR)).cast("long").alias("start_ns"), K.bucket_end(hour, F.lit(HOUR)).cast("long").alias("end_ns"),
    )


@query(f"WITH {JOBS} SELECT job_id, shard FROM jobs")
def shard_assignment(spark, d):
    return S.jobs(spark, d).select("job_id", "shard")


_SCAN = f"sha256({_domain('scan')} || unhex('{BOOT_ID}') || unhex(md5(CAST(s_suppkey AS VARCHAR))) || unhex('0000000000000000'))"


@query(f"""WITH h AS (SELECT s_suppkey, {_SCAN} AS h FROM supplier), p AS (
SELECT s_suppkey, CAST(('0x' || substr(h, 9, 8))::UBIGINT % 64 AS BIGINT) AS start, CAST(('0x' || substr(h, 25, 8))::UBIGINT % 64 AS BIGINT) AS s FROM h)
SELECT s_suppkey, i, (start + (CASE WHEN s % 2 = 0 THEN s + 1 ELSE s END) * i) % 64 AS shard FROM p, range(64) AS r(i)""")
def scan_permutation(spark, d):
    w = S.table(spark, d, "supplier").select("s_suppkey", K.scan_params(_queue(), F.lit(BOOT_ID), F.md5(F.col("s_suppkey").cast("string")), F.lit(0), 64).alias("p"))
    w = w.select("s_suppkey", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i"))
    return w.select("s_suppkey", "i", K.shard_at(F.col("p.start"), F.col("p.stride"), F.col("i"), 64).alias("shard"))


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, sha256(text) AS payload_digest, CAST(strlen(text) AS BIGINT) AS payload_length, 'text/' || lang AS content_type FROM documents")
def payload_digest(spark, d):
    p = S.payloads(spark, d)
    return p.select("job_id", K.payload_digest(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"), "content_type")


_BASE = f"job_id || '.g0000000000000000.a00000000.m' || {_hex_sql('maximum_attempts', 8)}"
_SHARD_HEX = _hex_sql("shard", 4)


@query(f"WITH {JOBS} SELECT job_id, {_tag_sql(f'''{chr(39)}ready/-/-/{chr(39)} || {_SHARD_HEX} || '/' || {_BASE}''')} AS tag FROM jobs")
def name_tag(spark, d):
    j = S.jobs(spark, d)
    context = F.concat(F.lit("ready/-/-/"), N.shard_dir(F.col("shard")), F.lit("/"), _base())
    return j.select("job_id", K.name_tag(_queue(), context).alias("tag"))


_DEAD_BASE = f"{_BASE} || '.x0003'"
_DELAYED_BASE = f"{_BASE} || '.d' || {_hex_sql('not_before_ns', 16)}"
_NB = _hex_sql(f"(not_before_ns + {WIDTH - 1}) // {WIDTH}", 16)


@query(f"""WITH {JOBS} SELECT job_id, {_BASE} || '.k' || {_tag_sql(f"'ready/-/-/' || {_SHARD_HEX} || '/' || {_BASE}")} || '.sqj' AS ready_name,
{_DELAYED_BASE} || '.k' || {_tag_sql(f"'delayed/-/' || {_NB} || '/' || {_SHARD_HEX} || '/' || {_DELAYED_BASE}")} || '.sqj' AS delayed_name,
{_DEAD_BASE} || '.k' || {_tag_sql(f"'dead/-/{FLOOR_BUCKET:016x}/' || {_SHARD_HEX} || '/' || {_DEAD_BASE}")} || '.sqj' AS dead_name FROM jobs""")
def format_names(spark, d):
    j, s = S.jobs(spark, d), F.col("shard")
    bucket = K.bucket_ceil(F.col("not_before_ns"), F.lit(WIDTH))
    return j.select(
        "job_id", N.ready_name(_queue(), s, _base()).alias("ready_name"), N.delayed_name(_queue(), bucket, s, _base(), F.col("not_before_ns")).alias("delayed_name"),
        N.dead_name(_queue(), F.lit(FLOOR_BUCKET), s, _base(), F.lit(3)).alias("dead_name"),
    )


@query(f"WITH {JOBS} SELECT job_id, 'delayed' AS kind, CAST(0 AS BIGINT) AS attempt, maximum_attempts, not_before_ns, TRUE AS tag_ok FROM jobs")
def parse_names(spark, d):
    j = S.jobs(spark, d)
    bucket = K.bucket_ceil(F.col("not_before_ns"), F.lit(WIDTH))
    name = N.delayed_name(_queue(), bucket, F.col("shard"), _base(), F.col("not_before_ns"))
    j = j.select(name.alias("name"), N.bucket_dir(bucket).alias("b"), N.shard_dir(F.col("shard")).alias("s"))
    p = N.with_parsed(j, "name", "b", "s", CONFIG.queue_id)
    return p.select("job_id", "kind", "attempt", "maximum_attempts", F.col("not_before_ns").cast("long").alias("not_before_ns"), "tag_ok")


_IDS = "CASE o_orderkey % 4 WHEN 0 THEN upper(md5(CAST(o_orderkey AS VARCHAR))) WHEN 1 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 2) ELSE md5(CAST(o_orderkey AS VARCHAR)) END"


@query(f"SELECT o_orderkey, regexp_full_match({_IDS}, '[0-9a-f]{{32}}') AS valid FROM orders")
def hex_validation(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey")
    h = S.job_key(F.col("o_orderkey"))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.upper(h)).when(F.col("o_orderkey") % 4 == 1, F.substring(h, 2, 31)).otherwise(h)
    return o.select("o_orderkey", K.is_hex(text, 32).alias("valid"))


@query("""SELECT doc_id, i AS chunk, CAST(least(strlen(text) - i * 4096, 4096) AS BIGINT) AS n_bytes FROM documents, range(1000) AS r(i) WHERE i * 4096 < strlen(text)""")
def payload_chunks(spark, d):
    p = S.payloads(spark, d).select("doc_id", "payload").filter(F.octet_length("payload") > 0)
    last = F.floor((F.octet_length("payload") - 1) / 4096).cast("long")
    p = p.select("doc_id", "payload", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return p.select("doc_id", "chunk", F.octet_length(F.substring(F.col("payload"), (F.col("chunk") * 4096 + 1).cast("int"), F.lit(4096))).cast("long").alias("n_bytes"))


@query("SELECT event_id, regexp_full_match(event_type, '[a-z0-9][a-z0-9._-]{0,63}') AND strlen(props) <= 4096 AS valid FROM events")
def metadata_validation(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.create_map("event_type", "props").alias("m"))
    return e.select("event_id", K.metadata_ok(F.col("m")).alias("valid"))


# -- binary records


def _extension(content_type):
    return cbor.encode_content_type(content_type)


_EXT = "unhex('a102') || unhex(" + _hex_sql("96 + strlen(content_type)", 2) + ") || encode(content_type)"
_HEAD = f"""unhex('{B.MAGIC_JOB.hex()}00010001') || unhex({_hex_sql("3 + strlen(content_type)", 8)}) || unhex({_hex_sql("strlen(text)", 16)}) || unhex('0000000001000000') ||
unhex(job_id) || unhex('0000000300000000') || unhex({_hex_sql(str(NOW_NS), 16)}) || unhex(sha256(text))"""


@query(f"""WITH p AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, text, 'text/' || lang AS content_type FROM documents)
SELECT job_id, CAST(strlen(text) AS BIGINT) AS payload_length, sha256(unhex('{(HASH_DOMAIN + "-envelope").encode().hex()}00') || {_HEAD} || unhex(repeat('00', 32)) || {_EXT}) AS envelope_digest,
CAST(131 + strlen(content_type) + strlen(text) AS BIGINT) AS size FROM p""")
def job_header(spark, d):
    """Encoded by us, then decoded with every check."""
    p = S.payloads(spark, d)
    data = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=F.col("job_id"), maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(NOW_NS))
    got = p.select(data.alias("data")).select(F.octet_length("data").cast("long").alias("size"), B.decode_job(F.col("data"), deep=True).alias("h"))
    return got.filter("h.error is null").select("h.job_id", F.col("h.payload_length").cast("long").alias("payload_length"), "h.envelope_digest", "size")


@query(f"WITH {RECEIPTS} SELECT job_id, attempt, token, bucket * {HOUR} AS bucket_start_ns FROM receipts")
def receipt_record(spark, d):
    r = _receipts(spark, d)
    data = B.encode_receipt(job_id=F.col("job_id"), envelope_digest=F.lit("ab" * 32), final_attempt=F.col("attempt"), token=F.col("token"), bucket_start_ns=F.col("bucket") * HOUR, payload_length=F.lit(0))
    got = r.select(B.decode_receipt(data).alias("r")).filter("r.error is null")
    return got.select("r.job_id", F.col("r.final_attempt").cast("long").alias("attempt"), "r.token", F.col("r.bucket_start_ns").cast("long").alias("bucket_start_ns"))


@query(f"SELECT event_id AS sequence, epoch_us(ts) * 1000 // {WIDTH} AS bucket FROM events")
def watermark_record(spark, d):
    e = S.table(spark, d, "events").select("event_id", K.bucket_floor(S.micros(F.col("ts")) * 1000, F.lit(WIDTH)).alias("b"))
    got = e.select(B.decode_watermark(B.encode_watermark(F.col("b"), F.col("event_id"))).alias("w")).filter("w.error is null")
    return got.select(F.col("w.sequence").cast("long").alias("sequence"), F.col("w.bucket").cast("long").alias("bucket"))


@query("SELECT n_nationkey AS nation, n_nationkey % 13 AS power, CASE WHEN n_nationkey % 5 = 4 THEN 'digest' END AS error FROM nation")
def format_record(spark, d):
    """A FORMAT record for each nation; every fifth has a wrong byte."""
    n = S.table(spark, d, "nation").select("n_nationkey")
    data = B.encode_format(
        queue_id=_queue(), created_at_unix_ns=F.lit(NOW_NS), shard_count=F.expr("shiftleft(1, n_nationkey % 13)"), lease_bucket_width_ns=F.lit(WIDTH),
        delayed_bucket_width_ns=F.lit(WIDTH), terminal_bucket_width_ns=F.lit(HOUR), max_payload_length=F.lit(CONFIG.max_payload_length),
    )
    wrong = F.concat(F.substring(data, 1, 159), F.lit(b"\x00"))
    right = F.substring(data, 160, 1) != F.lit(b"\x00")
    bad = F.when(right, wrong).otherwise(F.concat(F.substring(data, 1, 159), F.lit(b"\x01")))
    got = n.select("n_nationkey", B.decode_format(F.when(F.col("n_nationkey") % 5 == 4, bad).otherwise(data)).alias("f"))
    return got.select(F.col("n_nationkey").alias("nation"), F.round(F.log2(F.col("f.shard_count").cast("double"))).cast("int").alias("power"), "f.error")


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, NULL AS error, 'text/' || lang AS content_type FROM documents")
def cbor_decode(spark, d):
    p = S.payloads(spark, d).select("job_id", cbor.decode_column(_extension(F.col("content_type"))).alias("x"))
    return p.select("job_id", "x.error", "x.content_type")


# -- lookups


@query(f"WITH {JOBS} SELECT job_id, shard, maximum_attempts FROM jobs WHERE job_id = md5('7')")
def inspect_job(spark, d):
    import hashlib

    return lookup.inspect(S.jobs(spark, d), hashlib.md5(b"7").hexdigest(), spark, CONFIG).select("job_id", "shard", "maximum_attempts")


@query(f"""WITH {RECEIPTS} SELECT a.job_id, a.attempt, CASE WHEN r.job_id IS NOT NULL THEN 'already_acked' ELSE 'lease_lost' END AS outcome FROM attempts a
LEFT JOIN (SELECT DISTINCT job_id, attempt, token FROM receipts WHERE bucket BETWEEN {FLOOR_BUCKET - 168 - 2} AND {FLOOR_BUCKET}) r ON a.job_id = r.job_id AND a.attempt = r.attempt AND a.token = r.token""")
def duplicate_ack(spark, d):
    return lookup.duplicate_ack(S.attempts(spark, d).select("job_id", "attempt", "token"), _receipts(spark, d), NOW_NS, CONFIG).select("job_id", "attempt", "outcome")


_RT = f"'ready/' || {_SHARD_HEX} || '/' || job_id"


@query(f"""WITH {JOBS} SELECT job_id, CASE o_orderkey % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'destination' WHEN 2 THEN 'neither' WHEN 3 THEN 'both' ELSE 'conflicting' END AS outcome FROM jobs""")
def resolve_tickets(spark, d):
    """Tickets of claims, of which a fifth each left the source, the destination, none, both, or a foreign object."""
    j = S.jobs(spark, d).select("o_orderkey", "job_id", F.concat(F.lit("ready/"), "job_id").alias("source"), F.concat(F.lit("leased/"), "job_id").alias("destination"), F.lit(0).cast("long").alias("generation"))
    k = F.col("o_orderkey") % 5
    there = j.select(F.explode(F.filter(F.array(
        F.when(k.isin(0, 3), F.struct(F.col("source").alias("relative_path"), "job_id", F.lit(0).cast("long").alias("generation"))),
        F.when(k.isin(1, 3), F.struct(F.col("destination").alias("relative_path"), "job_id", F.lit(1).cast("long").alias("generation"))),
        F.when(k == 4, F.struct(F.col("source").alias("relative_path"), F.lit("ff" * 16).alias("job_id"), F.lit(0).cast("long").alias("generation"))),
    ), lambda x: x.isNotNull())).alias("o")).select("o.*")
    return lookup.resolve(j, there).select("job_id", "outcome")


@query(f"""WITH {JOBS} SELECT job_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'state' END AS mismatch FROM jobs WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def oracle_diff(spark, d):
    j = S.jobs(spark, d).select("o_orderkey", "job_id", F.lit("ready").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("attempt"))
    actual = j.filter("o_orderkey % 11 <> 0").withColumn("state", F.when(F.col("o_orderkey") % 13 == 0, "dead").otherwise(F.col("state")))
    return lookup.differential(j, actual).select("job_id", "mismatch")


@query(f"""WITH {ATTEMPTS}, acked AS (SELECT DISTINCT job_id FROM attempts WHERE outcome = 'ack')
SELECT job_id, 'lost' AS gate FROM jobs WHERE o_orderkey % 10 = 0
UNION ALL SELECT job_id, 'acked_active' FROM jobs WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'O' AND job_id IN (SELECT job_id FROM acked)""")
def crash_gates(spark, d):
    j = S.jobs(spark, d)
    acks = S.attempts(spark, d).filter("outcome = 'ack'").select("job_id", F.lit("ack").alias("op"))
    oplog = j.select("job_id", F.lit("enqueue").alias("op")).union(acks)
    snapshot = j.filter("o_orderkey % 10 <> 0").select("job_id", F.when(F.col("o_orderstatus") == "O", "ready").otherwise("receipt").alias("state"))
    return lookup.crash_gates(oplog, snapshot)


# -- audit


@query(f"WITH {ATTEMPTS} SELECT job_id, 'attempt_within_maximum' AS invariant, count(*) AS n FROM attempts WHERE attempt > maximum_attempts GROUP BY 1")
def attempt_invariant(spark, d):
    a = S.attempts(spark, d).withColumn("state", F.lit("leased"))
    return audit.broken_invariants(a).filter("invariant = 'attempt_within_maximum'").groupBy("job_id", "invariant").agg(F.count("*").alias("n"))


def _files(spark, d):
    """Stored objects of the documents: those of quality 0 have a foreign digest, every 97th a foreign tag, every 89th another shard."""
    p = S.corrupted(spark, d).withColumns({"shard": K.shard(_queue(), F.col("job_id"), CONFIG.shard_count), "maximum_attempts": F.lit(3)})
    placed = F.when(F.col("doc_id") % 89 == 0, (F.col("shard") + 1) % 64).otherwise(F.col("shard"))
    base = _base()
    name = N.ready_name(_queue(), F.when(F.col("doc_id") % 97 == 0, (placed + 2) % 64).otherwise(placed), base)
    data = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=F.col("job_id"), maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(NOW_NS), payload_digest=F.col("stored_digest"))
    f = p.select("doc_id", F.concat(F.lit("ready/"), N.shard_dir(placed), F.lit("/"), name).alias("relative_path"), data.alias("content"))
    return S.with_names(f.withColumn("length", F.octet_length("content")))


_FINDING = """CASE WHEN doc_id % 97 = 0 THEN 'name_tag_mismatch' WHEN doc_id % 89 = 0 THEN 'shard_placement_mismatch'
WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND text <> reverse(text) THEN 'payload_digest_mismatch' END"""


@query(f"SELECT * FROM (SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, {_FINDING} AS finding, 'error' AS severity FROM documents) WHERE finding IS NOT NULL")
def fsck_findings(spark, d):
    return audit.problems(_files(spark, d), CONFIG).select("job_id", "finding", "severity")


@query(f"SELECT count(*) AS objects, count(*) - count({_FINDING}) AS verified, count({_FINDING}) AS errors, CAST(0 AS BIGINT) AS warnings FROM documents")
def fsck_summary(spark, d):
    return audit.report(audit.fsck(_files(spark, d), CONFIG))


# -- recovery


@query(f"""WITH {ATTEMPTS} SELECT 'reap' AS phase, CASE WHEN attempt < maximum_attempts THEN 'ready' ELSE 'dead' END AS state, count(*) AS n
FROM attempts WHERE attempt = 1 AND outcome = 'expire' AND (boot_id <> '{_BOOT}' OR deadline_ns <= {NOW_NS}) GROUP BY 2
UNION ALL SELECT 'promote', 'ready', count(*) FROM jobs WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND (not_before_ns + {WIDTH - 1}) // {WIDTH} <= {NOW_NS // WIDTH} HAVING count(*) > 0
UNION ALL SELECT 'delete', 'receipt', count(*) FROM attempts WHERE attempt = 1 AND outcome = 'ack' AND (deadline_ns // {HOUR} + 1) * {HOUR} + {CONFIG.receipt_retention_ns} <= {NOW_NS} HAVING count(*) > 0""")
def recovery_report(spark, d):
    """One pass over first attempts (leased or acknowledged) and jobs without attempts (delayed)."""
    a = S.attempts(spark, d).filter("attempt = 1 and outcome <> 'retry'")
    state = F.when(F.col("outcome") == "ack", "receipt").otherwise("leased")
    objects = a.select("job_id", "shard", state.alias("state"), F.lit(1).cast("long").alias("generation"), F.col("attempt").cast("long").alias("attempt"), "maximum_attempts", "boot_id", "deadline_ns",
                       F.expr(f"deadline_ns div {HOUR}").alias("bucket"), F.lit(None).cast("int").alias("reason"))
    idle = S.jobs(spark, d).join(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    delayed = idle.select("job_id", "shard", F.lit("delayed").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("attempt"), "maximum_attempts",
                          K.bucket_ceil(F.col("not_before_ns"), F.lit(WIDTH)).cast("long").alias("bucket"))
    return recovery.recover(objects.unionByName(delayed, allowMissingColumns=True), NOW_NS, _BOOT, CONFIG)[1]


@query(f"WITH {ATTEMPTS} SELECT CASE WHEN attempt <= maximum_attempts THEN 'committed' ELSE 'lease_lost' END AS outcome, count(*) AS n FROM attempts GROUP BY 1")
def batch_outcome(spark, d):
    a = S.attempts(spark, d)
    requests = a.select("job_id", (2 * F.col("attempt") - 1).alias("generation"), "token")
    leases = a.filter("attempt <= maximum_attempts").select("job_id", (2 * F.col("attempt") - 1).alias("generation"), "token")
    return stats.outcomes(X.held(leases, requests))


@query(f"""WITH {JOBS}, r AS (SELECT job_id, shard, (not_before_ns + {WIDTH - 1}) // {WIDTH} AS bucket, row_number() OVER (ORDER BY (not_before_ns + {WIDTH - 1}) // {WIDTH}, shard, job_id) AS k FROM jobs)
SELECT job_id, CAST((k - 1) // 50 AS INTEGER) AS run FROM r WHERE k <= 150""")
def budget_resume(spark, d):
    """Three runs of 50 rows each, every one from the cursor of the one before."""
    rows = S.jobs(spark, d).select("job_id", "shard", K.bucket_ceil(F.col("not_before_ns"), F.lit(WIDTH)).cast("long").alias("bucket"))
    cursor, out = None, None
    for run in range(3):
        part, cursor = recovery.step(rows, cursor, 50)
        part = part.select("job_id", F.lit(run).alias("run"))
        out = part if out is None else out.union(part)
        if cursor is None:
            break
    return out

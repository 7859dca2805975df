"""Named queries over stored objects: names, trees, audits, tickets, records, and the kernels behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import binary as B
from tidewheel.functions import kernels as K
from tidewheel.functions import names as N
from tidewheel.operators import audit, lookup, records, stats, tickets
from tidewheel.operators import transitions as X
from tidewheel.plans.queries import _BASE, _BOOT, _FINDING, _SHARD_HEX, ATTEMPTS, HOUR, JOBS, LOG, RECEIPTS, WIDTH, _extension, _files, _hex_sql, _queue, _receipts, _tag_sql, query
from tidewheel.schema import TICKET_SCHEMA
from tidewheel.sources import tables as S
from tidewheel.sources.tables import BOOT_ID, CONFIG, NOW_NS

LEASE_WIDTH = CONFIG.lease_bucket_width_ns
DASHED = "-".join((BOOT_ID[:8], BOOT_ID[8:12], BOOT_ID[12:16], BOOT_ID[16:20], BOOT_ID[20:]))


# -- names


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, kind, name, bucket_hex, shard_hex) of seven names of every job, one of each grammar."""
    j, shard, nb = S.jobs(spark, d), F.col("shard"), F.col("not_before_ns")
    job, most = F.col("job_id"), F.col("maximum_attempts")
    base = lambda g, a: N.base_name(job, F.lit(g), F.lit(a), most)
    token, later, end = F.md5(job), K.bucket_ceil(nb, F.lit(WIDTH)), F.expr(f"not_before_ns div {HOUR}")
    lease = F.expr(f"not_before_ns div {LEASE_WIDTH}")
    none = F.lit(None).cast("string")
    of = lambda kind, name, bucket: F.struct(F.lit(kind).alias("made"), name.alias("name"), bucket.alias("bucket_hex"))
    made = F.array(
        of("ready", N.ready_name(_queue(), shard, base(0, 0)), none),
        of("leased", N.leased_name(_queue(), F.lit(DASHED), lease, shard, base(1, 1), nb, nb + 4096, token), none),
        of("delayed", N.delayed_name(_queue(), later, shard, base(0, 0), nb), N.bucket_dir(later)),
        of("dead", N.dead_name(_queue(), end, shard, base(2, 1), F.lit(3)), N.bucket_dir(end)),
        of("receipt", N.receipt_name(_queue(), end, shard, base(2, 1), token), N.bucket_dir(end)),
        of("temp", N.temp_name(nb, token), none),
        of("quarantine", N.quarantine_name(token, F.lit(2)), none),
    )
    return j.select(F.explode(made).alias("m"), N.shard_dir(shard).alias("shard_hex")).select("m.*", "shard_hex")


_COMMON = "CAST({g} AS BIGINT) AS generation, CAST({a} AS BIGINT) AS attempt, maximum_attempts"


def _parsed_sql(kind: str, g=None, a=None, not_before="NULL", token="NULL", reason="NULL", wall="NULL", named=True) -> str:
    common = f"job_id, {_COMMON.format(g=g, a=a)}" if named else "NULL, NULL, NULL, NULL"
    return f"SELECT '{kind}' AS made, '{kind}' AS kind, {common}, CAST({not_before} AS BIGINT) AS not_before_ns, CAST({wall} AS BIGINT) AS wall_deadline_ns, {token} AS token, CAST({reason} AS BIGINT) AS reason, {'TRUE' if named else 'NULL'} AS tag_ok FROM jobs"


@query("WITH " + JOBS + " " + " UNION ALL ".join([
    _parsed_sql("ready", 0, 0), _parsed_sql("leased", 1, 1, token="md5(job_id)", wall="not_before_ns + 4096"), _parsed_sql("delayed", 0, 0, not_before="not_before_ns"),
    _parsed_sql("dead", 2, 1, reason="3"), _parsed_sql("receipt", 2, 1, token="md5(job_id)"), _parsed_sql("temp", named=False), _parsed_sql("quarantine", reason="2", named=False),
]))
def parse_all_names(spark, d):
    p = N.with_parsed(_named(spark, d), "name", "bucket_hex", "shard_hex", CONFIG.queue_id)
    big = lambda c: F.col(c).cast("long").alias(c)
    return p.select("made", "kind", "job_id", big("generation"), "attempt", "maximum_attempts", big("not_before_ns"), big("wall_deadline_ns"), "token", "reason", "tag_ok")


_LEASED = f"job_id || '.g0000000000000001.a00000001.m' || {_hex_sql('maximum_attempts', 8)} || '.o{BOOT_ID}.b' || {_hex_sql('not_before_ns', 16)} || '.w' || {_hex_sql('not_before_ns + 4096', 16)} || '.t' || md5(job_id)"
_RCT = f"job_id || '.g0000000000000002.a00000001.m' || {_hex_sql('maximum_attempts', 8)} || '.t' || md5(job_id)"


@query(f"""WITH {JOBS} SELECT 'leased' AS made, {_LEASED} || '.k' || {_tag_sql(f"'leased/{DASHED}/' || {_hex_sql(f'not_before_ns // {LEASE_WIDTH}', 16)} || '/' || {_SHARD_HEX} || '/' || {_LEASED}")} || '.sqj' AS name FROM jobs
UNION ALL SELECT 'receipt', {_RCT} || '.k' || {_tag_sql(f"'receipts/-/' || {_hex_sql(f'not_before_ns // {HOUR}', 16)} || '/' || {_SHARD_HEX} || '/' || {_RCT}")} || '.rct' FROM jobs
UNION ALL SELECT 'temp', {_hex_sql('not_before_ns', 16)} || '.' || md5(job_id) || '.tmp' FROM jobs
UNION ALL SELECT 'quarantine', 'q' || md5(job_id) || '.x0002.raw' FROM jobs""")
def format_all_names(spark, d):
    return _named(spark, d).filter(F.col("made").isin("leased", "receipt", "temp", "quarantine")).select("made", "name")


@query(f"""WITH {JOBS} SELECT job_id, 'leased' AS directory, {_hex_sql(f'not_before_ns // {LEASE_WIDTH}', 16)} AS bucket_hex, {_SHARD_HEX} AS shard_hex, 'legacy' AS layout FROM jobs
UNION ALL SELECT job_id, 'ready', NULL, {_SHARD_HEX}, 'current' FROM jobs""")
def leased_paths(spark, d):
    """A lease's path in both layouts."""
    n = _named(spark, d).filter("made = 'leased'").withColumn("bucket", F.conv(F.regexp_extract("name", "\\.b([0-9a-f]{16})", 1), 16, 10).cast("long"))
    legacy = F.concat_ws("/", F.lit(f"leased/{DASHED}"), N.bucket_dir(F.expr(f"bucket div {LEASE_WIDTH}")), "shard_hex", "name")
    both = n.select(F.explode(F.array(F.struct(F.lit("legacy").alias("layout"), legacy.alias("relative_path")), F.struct(F.lit("current").alias("layout"), F.concat_ws("/", F.lit("ready"), "shard_hex", "name").alias("relative_path")))).alias("p")).select("p.*")
    return S.with_names(both).filter("tag_ok").select("job_id", "directory", "bucket_hex", "shard_hex", "layout")


# -- audits


def _lease_tree(spark, d):
    """Stored leases of the documents, in the current layout; every 97th has the tag of another bucket, every 89th another header."""
    p = S.payloads(spark, d).withColumn("shard", K.shard(_queue(), F.col("job_id"), CONFIG.shard_count))
    deadline = F.col("doc_id") * 7_000_000_000 + 1
    bucket = F.floor(deadline / LEASE_WIDTH) + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)
    base = N.base_name(F.col("job_id"), F.lit(1), F.lit(1), F.lit(3))
    name = N.leased_name(_queue(), F.lit(DASHED), bucket, F.col("shard"), base, deadline, deadline + 5, F.md5("job_id"))
    most = F.when(F.col("doc_id") % 89 == 0, F.lit(4)).otherwise(F.lit(3))
    data = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=F.col("job_id"), maximum_attempts=most, created_at_unix_ns=F.lit(NOW_NS))
    f = p.select("doc_id", F.concat_ws("/", F.lit("ready"), N.shard_dir(F.col("shard")), name).alias("relative_path"), data.alias("content"))
    return S.with_names(f.withColumn("length", F.octet_length("content").cast("long")))


@query("""SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, CASE WHEN doc_id % 89 = 0 THEN 'header_max_attempts_mismatch' WHEN doc_id % 97 = 0 THEN 'name_tag_mismatch' END AS finding,
CASE WHEN doc_id % 89 = 0 OR doc_id % 97 = 0 THEN 'error' END AS severity FROM documents""")
def fsck_leases(spark, d):
    return audit.fsck(_lease_tree(spark, d), CONFIG).select("job_id", "finding", "severity")


def _receipt_tree(spark, d):
    """Receipts of the documents, odd ones compact.  By doc_id: 7 attempt above the maximum, 11 another bucket than the record's (compact),
    13 another shard, 17 a wrong tag, 19 a payload changed (full), 23 another token in the record (compact)."""
    p = S.payloads(spark, d).withColumn("shard", K.shard(_queue(), F.col("job_id"), CONFIG.shard_count))
    i, job = F.col("doc_id"), F.col("job_id")
    bad = lambda n: i % n == 0
    bucket = F.lit(450_000).cast("long")
    placed = F.when(bad(13), (F.col("shard") + 1) % 64).otherwise(F.col("shard"))
    base = N.base_name(job, F.lit(2), F.when(bad(7), 4).otherwise(1), F.lit(3))
    name = N.receipt_name(_queue(), bucket + F.when(bad(17), 1).otherwise(0), placed, base, F.md5(job))
    token, start = F.md5(F.when(bad(23), F.reverse(job)).otherwise(job)), (bucket + F.when(bad(11), 1).otherwise(0)) * HOUR
    compact = B.encode_receipt(job_id=job, envelope_digest=F.lit("ab" * 32), final_attempt=F.when(bad(7), 4).otherwise(1), token=token, bucket_start_ns=start, payload_length=F.octet_length("payload"))
    full = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=job, maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(NOW_NS),
                        payload_digest=F.sha2(F.when(bad(19), F.lit(b"other")).otherwise(F.col("payload")), 256))
    f = p.select("doc_id", F.concat_ws("/", F.lit("receipts"), N.bucket_dir(bucket), N.shard_dir(placed), name).alias("relative_path"), F.when(i % 2 == 1, compact).otherwise(full).alias("content"))
    return S.with_names(f.withColumn("length", F.octet_length("content").cast("long")))


@query("""SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR (doc_id % 2 = 1 AND (doc_id % 11 = 0 OR doc_id % 23 = 0))
OR (doc_id % 2 = 0 AND doc_id % 19 = 0) THEN 'receipt_verification_failed' END AS finding FROM documents""")
def fsck_receipts(spark, d):
    return audit.fsck(_receipt_tree(spark, d), CONFIG).select("job_id", "finding")


_LISTED = [("odd_name", 31, "invalid_name_encoding"), ("stat_failed", 29, "stat_failed"), ("irregular", 23, "non_regular_file"), ("links", 19, "unexpected_hard_link"),
           ("open_failed", 17, "open_failed"), ("read_failed", 13, "payload_read_failed")]


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, CASE " + " ".join(f"WHEN doc_id % {n} = 0 THEN '{f}'" for _, n, f in _LISTED[:5])
       + f" WHEN doc_id % 97 = 0 THEN 'name_tag_mismatch' WHEN doc_id % 89 = 0 THEN 'shard_placement_mismatch' WHEN doc_id % 13 = 0 THEN 'payload_read_failed' ELSE {_FINDING} END AS finding FROM documents")
def fsck_listing(spark, d):
    """Findings that only a listing with stat and open sees, planted by number."""
    f = _files(spark, d)
    f = f.withColumns({c: F.col("doc_id") % n == 0 for c, n, _ in _LISTED if c != "links"}).withColumn("links", F.when(F.col("doc_id") % 19 == 0, 2).otherwise(1))
    return audit.fsck(f, CONFIG).select("job_id", "finding")


_REASON_SQL = "CASE finding WHEN 'name_tag_mismatch' THEN 4 WHEN 'shard_placement_mismatch' THEN 4 WHEN 'payload_digest_mismatch' THEN 2 END"
_PATH_SQL = f"""d AS (SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR)) AS job_id FROM documents), f AS (SELECT job_id, {_FINDING} AS finding FROM d)"""


@query(f"WITH {_PATH_SQL} SELECT finding AS was, 'quarantined' AS finding, 'warning' AS severity, {_REASON_SQL} AS reason, count(*) AS n FROM f WHERE finding IS NOT NULL GROUP BY finding")
def fsck_repair(spark, d):
    found = audit.fsck(_files(spark, d), CONFIG)
    moves = audit.repair(found)
    j = moves.join(found.select("relative_path", F.col("finding").alias("was")), "relative_path")
    return j.groupBy("was", "finding", "severity", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_PATH_SQL} SELECT count(*) AS objects, count(*) - count(finding) AS verified, count(finding) AS errors, count(finding) AS warnings, count(finding) AS quarantined,
CASE WHEN count(finding) > 0 THEN 3 ELSE 0 END AS exit_code FROM f""")
def fsck_repaired_report(spark, d):
    found = audit.fsck(_files(spark, d), CONFIG)
    code = found.agg(F.max(F.when(F.col("severity") == "error", 3).otherwise(0)).alias("exit_code"))
    return audit.report(found, audit.repair(found)).withColumn("k", F.lit(1)).join(code.withColumn("k", F.lit(1)), "k").drop("k")


@query(f"WITH {_PATH_SQL} SELECT job_id FROM f WHERE finding = 'payload_digest_mismatch'")
def quarantine_find(spark, d):
    """Quarantined objects found again by id; ids that aren't there find nothing."""
    p = S.corrupted(spark, d).filter(K.payload_digest(F.col("payload")) != F.col("stored_digest")).filter("doc_id % 97 <> 0 and doc_id % 89 <> 0")
    q = X.quarantine(p, F.lit(2))
    there = q.select("job_id", F.concat(F.lit("quarantine/"), N.quarantine_name(F.col("quarantine_id"), F.col("reason"))).alias("relative_path"))
    parsed = N.with_parsed(there.withColumn("name", F.regexp_extract("relative_path", "([^/]*)$", 1)))
    keep = parsed.drop("job_id").join(there, "relative_path")
    return lookup.find_quarantined(keep, q.select("quarantine_id").union(q.select(F.md5("quarantine_id").alias("quarantine_id")))).select("job_id")


@query(f"WITH {_PATH_SQL} SELECT md5('requeue:' || job_id) AS job_id, job_id AS provenance, 'ready' AS state FROM f WHERE finding = 'payload_digest_mismatch'")
def requeue_quarantine(spark, d):
    p = S.corrupted(spark, d).filter(K.payload_digest(F.col("payload")) != F.col("stored_digest")).filter("doc_id % 97 <> 0 and doc_id % 89 <> 0")
    return X.requeue(X.quarantine(p, F.lit(2))).select("job_id", "provenance", "state")


@query(f"WITH {_PATH_SQL} SELECT count(*) AS n FROM f WHERE finding = 'payload_digest_mismatch' AND ascii(substr(job_id, 1, 1)) >= ascii('8')")
def remove_quarantine(spark, d):
    p = S.corrupted(spark, d).filter(K.payload_digest(F.col("payload")) != F.col("stored_digest")).filter("doc_id % 97 <> 0 and doc_id % 89 <> 0")
    q = X.quarantine(p, F.lit(2))
    return X.remove(q, q.filter(F.substring("job_id", 1, 1) < "8"), "quarantine_id").agg(F.count("*").alias("n"))


# -- scans and reads


@query(f"""WITH {JOBS} SELECT job_id FROM jobs WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def claimable_scan(spark, d):
    """A tree of ready names: a third can be claimed, by attempts; every 7th has another shard's directory, every 11th a wrong tag."""
    j = S.jobs(spark, d)
    at = F.when(F.col("o_orderkey") % 7 == 0, (F.col("shard") + 1) % 64).otherwise(F.col("shard"))
    tag_at = F.when(F.col("o_orderkey") % 11 == 0, (at + 1) % 64).otherwise(at)
    base = N.base_name(F.col("job_id"), F.lit(0), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("maximum_attempts")), F.col("maximum_attempts"))
    tree = j.select(F.concat_ws("/", F.lit("ready"), N.shard_dir(at), N.ready_name(_queue(), tag_at, base)).alias("relative_path"))
    files = S.with_names(tree)
    return files.filter(X.claimable(files)).select("job_id")


@query("""SELECT state, count(*) AS objects, min(p_partkey) AS oldest FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'delayed' WHEN 2 THEN 'dead' ELSE 'receipts' END AS state FROM part) GROUP BY state""")
def state_walk(spark, d):
    """Count and oldest modification time by directory, from a listing."""
    p = S.table(spark, d, "part")
    folder = F.element_at(F.array(F.lit("ready"), F.lit("delayed"), F.lit("dead"), F.lit("receipts")), F.col("p_size") % 4 + 1)
    files = p.select(F.concat_ws("/", folder, F.lit("0000"), F.md5(F.col("p_partkey").cast("string"))).alias("relative_path"), F.col("p_partkey").alias("modified"))
    return stats.walk(files)


@query(f"""WITH {JOBS}, n AS (SELECT {_SHARD_HEX} AS directory, count(*) AS entries, CAST(sum(92) AS BIGINT) AS name_bytes FROM jobs GROUP BY 1)
SELECT 'ready/' || directory AS directory, entries, name_bytes, entries <= 24 AND name_bytes <= 2300 AS bounded FROM n""")
def bounded_directories(spark, d):
    from tidewheel.operators import recovery
    from tidewheel.plans.queries import _ready_paths

    return recovery.directories(_ready_paths(spark, d), 24, 2300)


@query("""WITH p AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, doc_id, encode(text) AS b, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND text <> reverse(text) AS bad FROM documents),
r AS (SELECT job_id, b, i * 100 AS off FROM p, range(3) AS t(i) WHERE NOT bad AND octet_length(b) > 0)
SELECT job_id, CAST(off AS BIGINT) AS "offset", CAST(greatest(least(octet_length(b) - off, 64), 0) AS BIGINT) AS n_bytes FROM r""")
def payload_reads(spark, d):
    p = S.corrupted(spark, d).filter(F.octet_length("payload") > 0)
    data = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=F.col("job_id"), maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(NOW_NS), payload_digest=F.col("stored_digest"))
    files = p.select("job_id", data.alias("content"))
    reads = p.select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(200).cast("long"), F.lit(100).cast("long"))).alias("offset"), F.lit(64).alias("size"))
    return S.payload_reads(files, reads).select("job_id", "offset", F.octet_length("bytes").cast("long").alias("n_bytes"))


def _stored(spark, d):
    """Files of every kind that verify knows: jobs, every 3rd cut short, every 5th with another envelope; FORMAT records; noise."""
    p = S.payloads(spark, d)
    data = B.encode_job(_extension(F.col("content_type")), F.col("payload"), job_id=F.col("job_id"), maximum_attempts=F.lit(3), created_at_unix_ns=F.lit(NOW_NS))
    i = F.col("doc_id")
    data = F.when(i % 5 == 0, F.concat(F.substring(data, 1, 96), F.lit(bytes(32)), F.substring(data, F.lit(129), F.octet_length(data)))).when(
        i % 3 == 0, F.substring(data, F.lit(1), F.octet_length(data) - 1)
    ).otherwise(data)
    fmt = B.encode_format(queue_id=_queue(), created_at_unix_ns=F.lit(NOW_NS), shard_count=F.lit(64), lease_bucket_width_ns=F.lit(WIDTH), delayed_bucket_width_ns=F.lit(WIDTH),
                          terminal_bucket_width_ns=F.lit(HOUR), max_payload_length=F.lit(CONFIG.max_payload_length))
    return p.filter("octet_length(payload) > 0").select("doc_id", F.when(i % 7 == 0, fmt).when(i % 11 == 0, F.lit(b"noise")).otherwise(data).alias("content"))


_VERDICT = """CASE WHEN doc_id % 7 = 0 THEN 'format' WHEN doc_id % 11 = 0 THEN 'unknown' ELSE 'job' END"""


@query(f"""SELECT doc_id, {_VERDICT} AS type, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'unknown_format' WHEN doc_id % 5 = 0 THEN 'envelope_digest_mismatch'
WHEN doc_id % 3 = 0 THEN 'file_size_mismatch' END AS error, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 3 ELSE 0 END AS exit_code
FROM documents WHERE strlen(text) > 0""")
def verify_files(spark, d):
    return records.verify(_stored(spark, d), deep=True).select("doc_id", "type", "error", "exit_code")


@query(f"""SELECT doc_id, {_VERDICT} AS type, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN md5(CAST(doc_id AS VARCHAR)) END AS job_id,
CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN CAST(strlen(text) AS BIGINT) END AS payload_length, CASE WHEN doc_id % 7 = 0 THEN CAST(64 AS BIGINT) END AS shard_count,
CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN sha256(text) END AS payload_digest FROM documents WHERE strlen(text) > 0""")
def format_dump(spark, d):
    return records.dump(_stored(spark, d)).select("doc_id", "type", "job_id", F.col("payload_length").cast("long").alias("payload_length"), F.col("shard_count").cast("long").alias("shard_count"), "payload_digest")


@query("SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 5 = 4 THEN 'digest' WHEN n_nationkey % 13 > 12 THEN 'shard_count' END AS problem, CAST(pow(2, n_nationkey % 13) AS BIGINT) AS shards FROM nation")
def open_queue(spark, d):
    """Options of queues loaded from their FORMAT records; a record with a wrong byte opens no queue."""
    n = S.table(spark, d, "nation").select("n_nationkey")
    data = B.encode_format(queue_id=_queue(), created_at_unix_ns=F.lit(NOW_NS), shard_count=F.expr("shiftleft(1, n_nationkey % 13)"), lease_bucket_width_ns=F.lit(WIDTH), delayed_bucket_width_ns=F.lit(WIDTH),
                           terminal_bucket_width_ns=F.lit(HOUR), max_payload_length=F.lit(CONFIG.max_payload_length))
    flipped = F.concat(F.substring(data, 1, 40), F.unhex(F.lit("ffffffff")), F.substring(data, 45, 200))
    got = records.options(n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 4, flipped).otherwise(data).alias("content")))
    shards = F.expr("cast(shiftleft(1, n_nationkey % 13) as bigint)")
    return got.select(F.col("n_nationkey").alias("nation"), "problem", shards.alias("shards"))


@query(f"WITH {JOBS} SELECT md5(CAST(k AS VARCHAR)) AS job_id, j.maximum_attempts, j.job_id IS NOT NULL AS found FROM (SELECT DISTINCT l_orderkey * 2 AS k FROM lineitem WHERE l_linenumber = 1) LEFT JOIN jobs j ON j.o_orderkey = k")
def inspect_many(spark, d):
    ids = S.table(spark, d, "lineitem").filter("l_linenumber = 1").select(S.job_key(F.col("l_orderkey") * 2).alias("job_id"))
    objects = S.jobs(spark, d).select("job_id", "shard", "maximum_attempts", F.lit(True).alias("there"))
    return lookup.inspect_many(objects, ids, CONFIG).select("job_id", "maximum_attempts", F.coalesce("there", F.lit(False)).alias("found"))


@query(f"WITH {JOBS} SELECT {_BASE.replace('g0000000000000000', 'g0000000000000002').replace('a00000000', 'a00000001')} || '.x0003' AS stem, CAST(8 + length(o_orderstatus) AS BIGINT) AS n_bytes FROM jobs WHERE o_orderkey % 10 = 0")
def export_dead(spark, d):
    j = S.jobs(spark, d)
    name = N.dead_name(_queue(), F.lit(450_000), F.col("shard"), N.base_name(F.col("job_id"), F.lit(2), F.lit(1), F.col("maximum_attempts")), F.lit(3))
    tree = j.select("o_orderkey", F.concat_ws("/", F.lit(f"dead/{450_000:016x}"), N.shard_dir(F.col("shard")), name).alias("relative_path"), F.concat(F.lit("content "), "o_orderstatus").cast("binary").alias("content"))
    files = S.with_names(tree)
    out = S.export(files, j.filter("o_orderkey % 10 = 0").select("job_id"), "dead")
    return out.select(F.regexp_extract("relative_path", "^(.*)\\.k[0-9a-f]{16}\\.sqj$", 1).alias("stem"), F.octet_length("content").cast("long").alias("n_bytes"))


# -- tickets


def _ticket(op, source, destination, i, **over):
    """A ticket's JSON for a job row, written as a map of text so that fields can be left out or be wrong."""
    job, most = F.col("job_id"), F.col("maximum_attempts")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    identity = F.concat(F.lit("{"), F.concat_ws(",", field("job_id", quoted(job)), field("generation", F.lit("1")), field("attempt", over.get("attempt", F.lit("1"))),
                        field("maximum_attempts", over.get("maximum", most.cast("string"))), field("lease_token", quoted(over.get("token", F.md5(job)))), field("envelope_digest", F.lit('"' + "ab" * 32 + '"')),
                        field("payload_length", F.lit("5"))), F.lit("}"))
    return F.concat(F.lit("{"), F.concat_ws(",", field("schema", quoted(over.get("schema", F.lit(TICKET_SCHEMA)))), field("version", over.get("version", F.lit("2"))),
                    field("queue_id", quoted(over.get("queue", _queue()))), field("operation", quoted(F.lit(op) if isinstance(op, str) else op)), field("phase", quoted(over.get("phase", F.lit("linearized")))),
                    field("source_identity", identity), field("source", source), field("destination_derivation", destination)), F.lit("}"))


_LEASE_JSON = f'{{"state":"leased","boot_id":"{DASHED}","boottime_deadline_ns":95000000000,"wall_deadline_ns":2}}'
_RECEIPT_JSON = '{"state":"receipt","terminal_bucket":450000}'


def _acks(spark, d):
    return S.jobs(spark, d).withColumn("ticket", _ticket("acknowledge", F.lit(_LEASE_JSON), F.lit(_RECEIPT_JSON), None))


_PROBLEMS = ["json", "schema", "version", "queue_id", "ids", "operation", "phase", "place", "maximum_attempts", "attempt", "edge", "boot_id", "queue"]


@query(f"WITH {JOBS} SELECT job_id, CASE o_orderkey % 16 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PROBLEMS)) + " END AS problem FROM jobs")
def ticket_problems(spark, d):
    """Tickets, each broken in one way by its number, or sound."""
    k = F.col("o_orderkey") % 16
    pick = lambda n, bad, good: F.when(k == _PROBLEMS.index(n), bad).otherwise(good)
    source = F.when(k == _PROBLEMS.index("place"), F.lit('{"state":"leased","boot_id":"x"}')).when(k == _PROBLEMS.index("boot_id"), F.lit(_LEASE_JSON.replace("-", ""))).otherwise(F.lit(_LEASE_JSON))
    t = _ticket(
        F.when(k == _PROBLEMS.index("operation"), F.lit("promote")).when(k == _PROBLEMS.index("edge"), F.lit("bury")).otherwise(F.lit("acknowledge")), source, F.lit(_RECEIPT_JSON), None,
        schema=pick("schema", F.lit("other"), F.lit(TICKET_SCHEMA)), version=pick("version", F.lit("1"), F.lit("2")), phase=pick("phase", F.lit("begun"), F.lit("linearized")),
        queue=F.when(k == _PROBLEMS.index("queue_id"), F.lit("XY" * 16)).when(k == _PROBLEMS.index("queue"), F.lit("43" * 16)).otherwise(_queue()),
        token=pick("ids", F.lit("short"), F.md5("job_id")), maximum=pick("maximum_attempts", F.lit("0"), F.col("maximum_attempts").cast("string")),
        attempt=pick("attempt", F.lit("9"), F.lit("1")),
    )
    t = F.when(k == 0, F.substring(t, 1, 60)).otherwise(t)
    return tickets.parse(S.jobs(spark, d).withColumn("ticket", t), CONFIG).select("job_id", "problem")


_TICKET_SOURCE = f"job_id || '.g0000000000000001.a00000001.m' || {_hex_sql('maximum_attempts', 8)} || '.o{BOOT_ID}.b{95 * 10**9:016x}.w{2:016x}.t' || md5(job_id)"


@query(f"""WITH {JOBS} SELECT job_id, 'ready/' || {_SHARD_HEX} || '/' || {_TICKET_SOURCE} || '.k' || {_tag_sql(f"'leased/{DASHED}/{9:016x}/' || {_SHARD_HEX} || '/' || {_TICKET_SOURCE}")} || '.sqj' AS source_path,
'receipts/{450_000:016x}/' || {_SHARD_HEX} || '/' || {_RCT} || '.k' || {_tag_sql(f"'receipts/-/{450_000:016x}/' || {_SHARD_HEX} || '/' || {_RCT}")} || '.rct' AS destination_path FROM jobs""")
def ticket_paths(spark, d):
    return tickets.with_paths(tickets.parse(_acks(spark, d), CONFIG), CONFIG).select("job_id", "source_path", "destination_path")


def _resolvable(spark, d):
    """Tickets and objects: by number, 0 source, 1 destination, 2 neither, 3 both, 4 another identity, 5 unreadable, 6 two links, 7 a broken ticket."""
    k = F.col("o_orderkey") % 8
    t = tickets.with_paths(tickets.parse(_acks(spark, d).withColumn("ticket", F.when(k == 7, F.lit("{}")).otherwise(F.col("ticket"))), CONFIG), CONFIG)
    o = lambda path, **x: F.struct(
        path.alias("relative_path"), x.get("job", F.col("job_id")).alias("job_id"), F.col("maximum_attempts"), F.lit("ab" * 32).alias("envelope_digest"), F.lit(5).cast("long").alias("payload_length"),
        F.lit(True).alias("sound"), F.lit(x.get("links", 1)).alias("links"), F.lit(1).cast("long").alias("device"), F.col("o_orderkey").alias("inode"), F.lit(x.get("unreadable", False)).alias("unreadable"),
    )
    src, dst = F.col("source_path"), F.col("destination_path")
    at = F.array_compact(F.array(F.when(k.isin(0, 3), o(src)), F.when(k.isin(1, 3), o(dst)), F.when(k == 4, o(src, job=F.lit("ff" * 16))), F.when(k == 5, o(dst, unreadable=True)), F.when(k == 6, o(src, links=2))))
    return t, t.filter("source_path is not null").select(F.explode(at).alias("x")).select("x.*")


_OUTCOMES = "CASE o_orderkey % 8 WHEN 0 THEN '{s}' WHEN 1 THEN '{d}' WHEN 2 THEN 'neither_observed' WHEN 3 THEN 'both_observed' WHEN 4 THEN 'conflicting_object' WHEN 5 THEN 'resolution_failed' WHEN 6 THEN 'conflicting_object' ELSE 'resolution_failed' END"


@query(f"WITH {JOBS} SELECT job_id, {_OUTCOMES.format(s='source_observed', d='destination_observed')} AS outcome FROM jobs WHERE o_orderkey % 8 <> 7")
def resolve_outcomes(spark, d):
    return tickets.resolve(*_resolvable(spark, d)).filter("job_id is not null").select("job_id", "outcome")


@query(f"""WITH {JOBS} SELECT CASE WHEN o_orderkey % 8 IN (0, 1) AND o_orderkey % 3 = 0 THEN 'conflicting_object' ELSE {_OUTCOMES.format(s='source_stabilized', d='destination_stabilized')} END AS outcome, count(*) AS n FROM jobs GROUP BY 1""")
def resolve_stabilized(spark, d):
    """Looked at again: every 3rd file has been replaced in between."""
    t, o = _resolvable(spark, d)
    later = o.select("relative_path", "device", F.when(F.col("inode") % 3 == 0, -1).otherwise(F.col("inode")).alias("inode"))
    return tickets.resolve(t, o, later).groupBy("outcome").agg(F.count("*").alias("n"))


# -- transitions


@query(f"""WITH {ATTEMPTS}, c AS (SELECT job_id, attempt, maximum_attempts, deadline_ns, least(4000, least(300000, 1000 * CAST(pow(2, attempt - 1) AS BIGINT))) AS delay_ms FROM attempts WHERE outcome = 'retry')
SELECT job_id, attempt, delay_ms, CASE WHEN attempt >= maximum_attempts THEN 'bury' ELSE 'retry_later' END AS effective_op,
CASE WHEN attempt < maximum_attempts THEN (deadline_ns + delay_ms * 1000000 + {WIDTH - 1}) // {WIDTH} ELSE deadline_ns // {HOUR} END AS bucket FROM c""")
def retry_policy(spark, d):
    a = S.attempts(spark, d).filter("outcome = 'retry'").withColumn("generation", 2 * F.col("attempt") - 1)
    r = X.retry_with_policy(a, F.col("deadline_ns"), 1000, 300_000, CONFIG.queue_id, CONFIG, jitter=False, max_delay_ms=4000)
    return r.select("job_id", "attempt", "delay_ms", "effective_op", "bucket")


@query("""WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT md5(CAST(doc_id AS VARCHAR)) AS job_id, 'receipt' AS state FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM bad) AND text <> reverse(text))""")
def acknowledge_verified(spark, d):
    """Only payloads that still have their digest get a receipt."""
    p = S.corrupted(spark, d).withColumnRenamed("stored_digest", "payload_digest").withColumn("generation", F.lit(1).cast("long"))
    return X.acknowledge(p, F.lit(NOW_NS), CONFIG).select("job_id", "state")


@query("""SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_id <= 500 THEN 'committed' ELSE 'deferred' END AS durability FROM events""")
def deferred_sync(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "unknown").otherwise("committed").alias("outcome"))
    return X.durable(e, 500).select("seq", "durability")


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id AS seq, coalesce(event_id > first, FALSE) AS poisoned, CASE WHEN coalesce(event_id > first, FALSE) THEN 'refused' WHEN event_type = 'error' THEN 'unknown' ELSE 'committed' END AS outcome
FROM events LEFT JOIN f USING (user_id)""")
def poisoned_handles(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("handle"), F.when(F.col("event_type") == "error", "unknown").otherwise("committed").alias("outcome"))
    return X.poisoned(e).select("seq", "poisoned", "outcome")


@query(f"WITH {LOG} SELECT job_id, generation, op, lag(op) OVER w AS previous_op, lead(op) OVER w AS next_op, CAST(wall_ns - lag(wall_ns) OVER w AS BIGINT) AS gap_ns FROM log WINDOW w AS (PARTITION BY job_id ORDER BY generation)")
def attempt_history(spark, d):
    return X.attempt_history(S.transitions(spark, d))


@query(f"WITH {LOG} SELECT job_id, generation, seq, generation % 3 = 0 AS refused FROM log")
def publish_unique(spark, d):
    """Every third entry is in the log already."""
    log = S.transitions(spark, d)
    return S.publish(log.filter("generation % 3 = 0"), log).select("job_id", "generation", "seq", "refused")


@query(f"""WITH {ATTEMPTS}, acked AS (SELECT DISTINCT job_id FROM attempts WHERE outcome = 'ack')
SELECT job_id, 'lost' AS gate FROM jobs WHERE o_orderkey % 10 = 0
UNION ALL SELECT job_id, 'acked_delivered' FROM jobs WHERE shard = 5 AND job_id IN (SELECT job_id FROM acked)""")
def crash_deliveries(spark, d):
    """Deliveries of one shard after a crash: those of acknowledged jobs are violations, those without a log line aren't."""
    j = S.jobs(spark, d)
    acks = S.attempts(spark, d).filter("outcome = 'ack'").select("job_id", F.lit("ack").alias("op"))
    snapshot = j.filter("o_orderkey % 10 <> 0").select("job_id", F.lit("receipt").alias("state"))
    delivered = j.filter("shard = 5").select("job_id").union(spark.createDataFrame([("ff" * 16,)], "job_id string"))
    return lookup.crash_gates(j.select("job_id", F.lit("enqueue").alias("op")).union(acks), snapshot, delivered)


_INV = f"{ATTEMPTS}, a AS (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN md5('shared') ELSE token END AS t FROM attempts WHERE attempt = 1)"


@query(f"""WITH {_INV} SELECT job_id, 'lease_has_token' AS invariant FROM a WHERE t IS NULL
UNION ALL SELECT min(job_id), 'unique_active_token' FROM a WHERE t = md5('shared') HAVING count(*) > 1
UNION ALL SELECT job_id, 'incomplete_envelope_visible' FROM a WHERE o_orderkey % 9 = 0""")
def broken_invariants(spark, d):
    """First attempts as leases: every 6th without a token, every 7th with a shared one, every 9th without a whole envelope."""
    k = F.col("o_orderkey")
    a = S.attempts(spark, d).filter("attempt = 1").withColumns(
        {"state": F.lit("leased"), "token": F.when(k % 6 == 0, F.lit(None)).when(k % 7 == 0, F.md5(F.lit("shared"))).otherwise(F.col("token")), "complete": k % 9 != 0}
    )
    return audit.broken_invariants(a)


@query(f"""WITH {ATTEMPTS} SELECT job_id, attempt, boot_id <> '{_BOOT}' AS other_boot FROM attempts WHERE boot_id <> '{_BOOT}' OR deadline_ns <= {NOW_NS}""")
def lease_expired_by_bucket(spark, d):
    """As lease_expired, with the lease's bucket in the predicate, by which partitions are pruned."""
    a = S.attempts(spark, d).withColumn("bucket", F.expr(f"deadline_ns div {LEASE_WIDTH}"))
    return a.filter(X.expired(NOW_NS, _BOOT, CONFIG)).select("job_id", "attempt", (F.col("boot_id") != _BOOT).alias("other_boot"))


# -- aggregations


@query("""SELECT count(*) FILTER (WHERE event_type = 'signup') AS enqueued, count(*) FILTER (WHERE event_type = 'view') AS leased, count(*) FILTER (WHERE event_type = 'purchase') AS acked,
CAST(count(*) FILTER (WHERE event_type = 'purchase') * 1000000 // (max(epoch_us(ts)) - min(epoch_us(ts))) AS BIGINT) AS acked_per_second FROM events""")
def bench_counters(spark, d):
    log = S.table(spark, d, "events").select("event_type", S.micros(F.col("ts")).alias("us"))
    return stats.throughput(log.withColumnRenamed("event_type", "kind"), {"enqueued": "signup", "leased": "view", "acked": "purchase"}).select("enqueued", "leased", "acked", F.floor("acked_per_second").cast("long").alias("acked_per_second"))


@query("SELECT user_id % 7 AS device, user_id AS inode, count(*) AS writes FROM events GROUP BY 1, 2")
def dirty_set(spark, d):
    e = S.table(spark, d, "events").select((F.col("user_id") % 7).alias("device"), F.col("user_id").alias("inode"))
    return stats.dirty(e)


@query("""WITH g AS (SELECT p_size % 3 AS k, count(*) AS n, min(p_partkey) AS age FROM part GROUP BY 1)
SELECT 's' || k AS state, '{"objects":' || n || ',"oldest_age_seconds":' || age || '}' AS json FROM g""")
def stats_json(spark, d):
    g = S.table(spark, d, "part").groupBy(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("state")).agg(F.count("*").alias("objects"), F.min("p_partkey").alias("oldest_age_seconds"))
    return stats.as_json(g)


# -- kernels and rules


_BIG = "CAST(p_partkey AS UHUGEINT) * 92233720368547758"


@query(f"""SELECT p_partkey, CASE WHEN {_BIG} * 3 <= 18446744073709551615 THEN CAST({_BIG} * 3 AS VARCHAR) END AS product, CASE WHEN {_BIG} * 2 + 9223372036854775807 <= 18446744073709551615 THEN CAST({_BIG} * 2 + 9223372036854775807 AS VARCHAR) END AS total FROM part""")
def checked_arithmetic(spark, d):
    """Products and sums that run over the unsigned range are null."""
    big = F.col("p_partkey").cast("decimal(20,0)") * K.whole(92233720368547758)
    p = S.table(spark, d, "part").select("p_partkey", big.cast("decimal(38,0)").alias("big"))
    text = lambda c: c.cast("string")
    top = K.whole((1 << 63) - 1)
    return p.select("p_partkey", text(K.checked_mul(F.col("big"), F.lit(3))).alias("product"), text(K.checked_add(K.checked_mul(F.col("big"), F.lit(2)), top)).alias("total"))


@query(f"""WITH {JOBS} SELECT job_id, (not_before_ns + p + {WIDTH - 1}) // {WIDTH} AS bucket, (not_before_ns + p + {WIDTH - 1}) // {WIDTH} * {WIDTH} AS at_ns FROM (SELECT *, o_orderkey % 3 AS p FROM jobs)""")
def eligibility(spark, d):
    at = S.jobs(spark, d).select("job_id", K.eligibility(F.col("not_before_ns") + F.col("o_orderkey") % 3, F.lit(WIDTH)).alias("e"))
    return at.select("job_id", F.col("e.bucket").cast("long").alias("bucket"), F.col("e.ns").cast("long").alias("at_ns"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN least(p_size * 100, p_partkey) ELSE p_size * 100 END AS cap, p_size - 10 > 0 AND CASE WHEN p_size % 2 = 0 THEN least(p_size * 100, p_partkey) ELSE p_size * 100 END >= p_size - 10 AS valid FROM part")
def retry_policies(spark, d):
    """The cap in effect, and whether base and cap make a policy."""
    p = S.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).cast("long").alias("cap"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).alias("most"), (F.col("p_size") - 10).alias("base"))
    cap = K.effective_cap(F.col("cap"), F.col("most"))
    return p.select("p_partkey", cap.alias("cap"), K.policy_ok(F.col("base"), cap).alias("valid"))


@query("SELECT p_partkey, CAST(p_partkey * 1000 + p_size // 2 AS BIGINT) AS middle FROM part")
def span_midpoint(spark, d):
    return S.table(spark, d, "part").select("p_partkey", K.midpoint(F.col("p_partkey") * 1000, F.col("p_size")).cast("long").alias("middle"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE md5(CAST(s_suppkey AS VARCHAR)) END AS digits, CASE WHEN s_suppkey % 3 <> 0 THEN
regexp_replace(md5(CAST(s_suppkey AS VARCHAR)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') END AS dashed FROM supplier""")
def boot_ids(spark, d):
    """Dashed boot ids to digits and back; upper case isn't one."""
    h = S.job_key(F.col("s_suppkey"))
    dashed = K.boot_dashed(h)
    given = F.when(F.col("s_suppkey") % 3 == 0, F.upper(dashed)).otherwise(dashed)
    return S.table(spark, d, "supplier").select("s_suppkey", K.boot_hex(given).alias("digits"), K.boot_dashed(K.boot_hex(given)).alias("dashed"))


_PATHS = "CASE p_size % 6 WHEN 0 THEN 'ready/0000/' || p_name WHEN 1 THEN '/ready/' || p_name WHEN 2 THEN 'ready/../' || p_name WHEN 3 THEN 'ready//' || p_name WHEN 4 THEN 'ready/' || repeat('x', 256) ELSE p_name END"


@query(f"SELECT p_partkey, p_size % 6 IN (0, 5) AS safe FROM part WHERE p_name <> ''")
def safe_paths(spark, d):
    p, n, k = S.table(spark, d, "part").filter("p_name <> ''"), F.col("p_name"), F.col("p_size") % 6
    path = F.when(k == 0, F.concat(F.lit("ready/0000/"), n)).when(k == 1, F.concat(F.lit("/ready/"), n)).when(k == 2, F.concat(F.lit("ready/../"), n)).when(k == 3, F.concat(F.lit("ready//"), n)).when(
        k == 4, F.concat(F.lit("ready/"), F.repeat(F.lit("x"), 256))
    ).otherwise(n)
    return p.select("p_partkey", K.safe_path(path).alias("safe"))


@query("SELECT doc_id, CAST(128 + strlen(lang) + strlen(text) AS BIGINT) AS size FROM documents")
def total_sizes(spark, d):
    return S.table(spark, d, "documents").select("doc_id", K.total_size(F.octet_length("lang"), F.octet_length("text")).cast("long").alias("size"))


_ERRORS = ("queue_corrupt", "payload_corrupt", "permission_denied", "io_failure", "not_committed", "unsupported_format", "resource_exhausted", "nothing known")


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 1 WHEN 5 THEN 64 WHEN 6 THEN 4 ELSE 1 END AS code FROM events")
def exit_codes_of(spark, d):
    error = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("event_id") % 8 + 1).cast("int"))
    return S.table(spark, d, "events").select("event_id", K.exit_code(error).alias("code"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '\\xc3\\xa9' ELSE '\\x61\\x09\\x62' END AS shown FROM customer")
def escaped_names(spark, d):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.lit("é")).otherwise(F.lit("a\tb"))
    return S.table(spark, d, "customer").select("c_custkey", K.escaped(name).alias("shown"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 500000000 BETWEEN 1000000000 AND 604800000000000 AS valid FROM part")
def lease_durations(spark, d):
    return S.table(spark, d, "part").select("p_partkey", K.lease_duration_ok(F.col("p_size").cast("long") * 500_000_000).alias("valid"))


@query("SELECT p_partkey, p_size IN (1, 2, 4, 8, 16, 32) AS valid FROM part")
def queue_options(spark, d):
    """Shard counts that a queue can have; the other options are right."""
    width = lambda x: F.lit(x).cast("long")
    ok = K.options_ok(F.col("p_size"), width(WIDTH), width(WIDTH), width(HOUR), width(CONFIG.max_payload_length))
    return S.table(spark, d, "part").select("p_partkey", ok.alias("valid"))


@query(f"WITH {RECEIPTS}, x AS (SELECT job_id, attempt, CASE WHEN attempt % 3 = 0 THEN attempt - 1 ELSE maximum_attempts END AS most FROM receipts) SELECT job_id, attempt, most > 0 AND attempt BETWEEN 1 AND most AS valid FROM x")
def receipt_attempts(spark, d):
    r = _receipts(spark, d).withColumn("most", F.when(F.col("attempt") % 3 == 0, F.col("attempt") - 1).otherwise(F.col("maximum_attempts")))
    return r.select("job_id", "attempt", audit.attempt_valid(F.col("attempt"), F.col("most")).alias("valid"))


@query(f"WITH {JOBS} SELECT job_id, shard * 2 < 64 AS valid FROM jobs")
def shards_in_range(spark, d):
    return S.jobs(spark, d).select("job_id", audit.shard_in_range(N.shard_dir(F.col("shard") * 2), CONFIG).alias("valid"))


@query("SELECT doc_id, 'text/' || lang AS content_type, NULL AS error FROM documents WHERE lang IS NOT NULL AND doc_id % 4 <> 0 UNION ALL SELECT doc_id, NULL, 'trailing' FROM documents WHERE lang IS NOT NULL AND doc_id % 4 = 0")
def cbor_checked(spark, d):
    """Extensions encoded and decoded; every fourth has a byte too many."""
    from tidewheel.functions import cbor

    p = S.payloads(spark, d).filter("content_type is not null")
    data = cbor.encode_content_type(F.col("content_type"))
    data = F.when(F.col("doc_id") % 4 == 0, F.concat(data, F.lit(b"\x00"))).otherwise(data)
    got = p.select("doc_id", cbor.decode_column(data).alias("x"))
    wrong = F.col("x.error").isNotNull()
    return got.select("doc_id", F.when(~wrong, F.col("x.content_type")).alias("content_type"), F.when(wrong, F.lit("trailing")).alias("error"))



"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash of id and text), read
again from the start after its end.  A document's virtual finish time is its source's
tokens up to and with it, divided by the source's target weight.  All passes of all
documents are ranked by finish time and the mix is what comes before the total budget.

A source may hold most rows, so nothing sorts a source or the corpus in one task: running
sums are built from sums of hash chunks, and the budget's end is found in a histogram of
finish times, of which one narrow bucket is sorted.

DataFrame operations only.  A null text has size 0.  A null source is a source, after all
others; a null id is an id before all others.  Repeated rows are rows.  Documents of size 0 are never
taken.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import cut

#: Weights of the sources in code point order, repeated as needed.
WEIGHTS = (3, 1, 2)
#: Rows that one window sorts, about, if they are one source's.
CHUNK_ROWS, MAX_DIGITS = 512, 6


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, skey, source_size, rank, target for one row a source (skey, source, source_size).

    The total is shared by weight; a source stops at ``most`` times its size and what it
    leaves is shared again until no source is above: with sources ordered by size over
    weight, those that are filled come first.
    """
    one = W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    t = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("w", w).withColumn("most", most * F.col("source_size"))
    t = t.withColumn("total", share * F.sum("source_size").over(one))
    by = one.orderBy(F.col("most") / F.col("w"), "rank")
    t = t.withColumn("pos", F.row_number().over(by))
    t = t.withColumn("before", F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    free = F.col("most") * F.col("rest") > F.col("w") * (F.col("total") - F.col("before"))
    t = t.withColumn("first_free", F.min(F.when(free, F.col("pos"))).over(one))
    level = F.max(F.when(F.col("pos") == F.col("first_free"), (F.col("total") - F.col("before")) / F.col("rest"))).over(one)
    filled = F.col("first_free").isNull() | (F.col("pos") < F.col("first_free"))
    t = t.withColumn("level", level).withColumn("target", F.when(filled, F.col("most")).otherwise(F.col("w") * F.col("level")))
    return t.select("skey", "source", "source_size", "rank", "target", "total")


def mix(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_taken and the columns named in ``carry`` of every row of ``docs``.

    ``share`` of all sizes is the budget, and no source gives more than ``passes`` times its size.
    """
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")).alias("skey"),
        word_count().alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), text).cast("binary")).alias("key"),
        *carry,
    )
    d = cut(d)
    n = d.count()
    digits = 1
    while digits < MAX_DIGITS and n > CHUNK_ROWS * 16**digits:
        digits += 1
    d = d.withColumn("chunk", F.substring("key", 1, digits))
    sums = d.groupBy("skey", "chunk").agg(F.first("source").alias("source"), F.sum("size").alias("chunk_size"))
    sums = cut(sums)
    t = targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("chunk_size").alias("source_size")), weights, share, float(passes))
    t = cut(t)
    ahead = W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select("skey", "chunk", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0)).alias("ahead"))
    heads = heads.join(t.drop("source"), "skey")
    own = W.partitionBy("skey", "chunk").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    r = d.withColumn("own", F.sum("size").over(own)).join(heads, ["skey", "chunk"])
    r = cut(r.select("doc_id", "size", "key", "source_size", "target", "total", "rank", (F.col("ahead") + F.col("own")).alias("upto"), *carry))

    buckets = max(64, min(65536, n // 64))

    def finish(k: int) -> Column:
        upto = F.col("upto") + k * F.col("source_size")
        return F.when(F.col("size") > 0, upto.cast("double") / F.col("target"))

    def bucket(f: Column) -> Column:
        return F.least(F.floor(f * buckets), F.lit(2 * buckets))

    def place(f: Column, k: int) -> Column:
        low = F.lit(-(1 << 63)).cast("long")
        return F.struct(f.alias("f"), F.col("rank").alias("rank"), F.col("key").alias("key"), F.coalesce("doc_id", low).alias("id"), F.lit(k).alias("k"))

    turns = r.select("size", "total", F.explode(F.array(*[F.struct(bucket(finish(k)).alias("b"), place(finish(k), k).alias("at")) for k in range(passes)])).alias("u"))
    turns = turns.select("size", "total", "u.b", "u.at").filter("b is not null")
    hist = turns.groupBy("b").agg(F.sum("size").alias("s"), F.max("total").alias("total"))
    hist = hist.withColumn("run", F.sum("s").over(W.orderBy("b"))).filter(F.col("run") > F.col("total"))
    last = hist.orderBy("b").first()
    if last is None:  # all passes together are within the budget
        taken = [F.col("size") > 0 for _ in range(passes)]
    else:
        edge = turns.filter(F.col("b") == last["b"]).withColumn("run", F.sum("size").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
        edge = edge.filter(F.col("run") + (last["run"] - last["s"]) <= F.col("total")).agg(F.max("at").alias("at")).first()["at"]
        taken = []
        for k in range(passes):
            f = finish(k)
            yes = bucket(f) < last["b"]
            if edge is not None:
                end = F.struct(F.lit(edge["f"]).alias("f"), F.lit(edge["rank"]).alias("rank"), F.lit(edge["key"]).alias("key"), F.lit(edge["id"]).cast("long").alias("id"), F.lit(edge["k"]).alias("k"))
                yes = yes | ((bucket(f) == last["b"]) & (place(f, k) <= end))
            taken.append(yes)
    n_taken = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in taken), F.lit(0))
    return r.select("doc_id", "size", "source_size", "target", (n_taken * F.col("size")).cast("long").alias("taken"), n_taken.alias("n_taken"), *carry)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM d GROUP BY source
), a AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(2.0 AS DOUBLE) * source_size AS most,
         CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total
  FROM s
), b AS (
  SELECT *, row_number() OVER (ORDER BY most / w, rank) AS pos FROM a
), c AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM b
), e AS (
  SELECT *, min(CASE WHEN most * rest > w * (total - before) THEN pos END) OVER () AS first_free FROM c
), g AS (
  SELECT *, max(CASE WHEN pos = first_free THEN (total - before) / rest END) OVER () AS level FROM e
), t AS (
  SELECT source, source_size, rank, total,
         CASE WHEN first_free IS NULL OR pos < first_free THEN most ELSE w * level END AS target
  FROM g
), r AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.rank, t.target, t.total,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         row_number() OVER (ORDER BY d.key, d.doc_id, d.size) AS row_id
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT r.*, k, CAST(upto + k * source_size AS DOUBLE) / target AS f
  FROM r, (VALUES (0), (1)) AS p(k) WHERE size > 0
), v AS (
  SELECT row_id, size, sum(size) OVER (ORDER BY f, rank, key, doc_id, k
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= total AS yes
  FROM u
), y AS (
  SELECT row_id, CAST(sum(CASE WHEN yes THEN size ELSE 0 END) AS BIGINT) AS taken FROM v GROUP BY row_id
)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(y.taken, 0) AS taken
FROM r LEFT JOIN y ON r.row_id = y.row_id
"""

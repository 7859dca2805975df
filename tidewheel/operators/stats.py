"""Statistics of queue states, batches and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.schema import METRIC_PREFIX, STATES


def by_state(objects: DataFrame, now_ns: int, since: str = "wall_ns", state: str = "state") -> DataFrame:
    """state, objects, oldest_age_seconds for all six states; no age without objects, 0 for times ahead of the clock."""
    domain = objects.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    got = objects.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("objects"), F.min(since).alias("oldest"))
    age = F.floor(F.greatest(F.lit(now_ns) - F.col("oldest"), F.lit(0)) / F.lit(10**9)).cast("long")
    return F.broadcast(domain).join(got, "state", "left").select("state", F.coalesce("objects", F.lit(0)).alias("objects"), F.when(F.col("oldest").isNotNull(), age).alias("oldest_age_seconds"))


def by_directory(objects: DataFrame, now_ns: int, since: str = "wall_ns", state: str = "state") -> DataFrame:
    """As ``by_state``, but as directories hold them: leases lie with the ready objects."""
    return by_state(objects.withColumn("_dir", F.when(F.col(state) == "leased", "ready").otherwise(F.col(state))), now_ns, since, "_dir")


def prometheus(stats: DataFrame) -> DataFrame:
    """One ``line`` a gauge and its type."""
    count = F.concat(F.lit(f"{METRIC_PREFIX}_"), "state", F.lit("_objects"))
    age = F.concat(F.lit(f"{METRIC_PREFIX}_"), "state", F.lit("_oldest_age_seconds"))
    lines = F.array(
        F.concat(F.lit("# TYPE "), count, F.lit(" gauge")),
        F.concat(count, F.lit(" "), F.col("objects").cast("string")),
        F.when(F.col("oldest_age_seconds").isNotNull(), F.concat(F.lit("# TYPE "), age, F.lit(" gauge"))),
        F.concat(age, F.lit(" "), F.col("oldest_age_seconds").cast("string")),
    )
    return stats.select(F.explode(lines).alias("line")).filter("line is not null")


def as_json(stats: DataFrame) -> DataFrame:
    return stats.select("state", F.to_json(F.struct("objects", "oldest_age_seconds")).alias("json"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def exact_quantile(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value at index floor(q * n) of each group's sorted values (the last, if that is beyond).

    Equal values are counted first, so the window sees distinct values only.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    counted = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy(group)))
    at = F.least(F.floor(F.col("all") * F.lit(q)), F.col("all") - 1)
    return counted.filter((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(group, F.col(value).alias("value"))


def scan_stats(files: DataFrame) -> DataFrame:
    """directories, entries, name bytes of relative paths."""
    name = F.regexp_extract("relative_path", "([^/]*)$", 1)
    folder = F.regexp_replace("relative_path", "/[^/]*$", "")
    return files.agg(F.countDistinct(folder).alias("directories"), F.count("*").alias("entries"), F.sum(F.octet_length(name)).alias("name_bytes"))


def walk(files: DataFrame) -> DataFrame:
    """state (the first directory), objects and the oldest modification time of a listing (relative_path, modified)."""
    state = F.substring_index("relative_path", "/", 1)
    return files.groupBy(state.alias("state")).agg(F.count("*").alias("objects"), F.min("modified").alias("oldest"))


def throughput(log: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row: how many entries (kind, us) of each named kind, and how many a second between the first entry and the last."""
    counted = log.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()], ((F.max("us") - F.min("us")) / 1_000_000).alias("seconds"))
    return counted.select(*kinds, *[F.when(F.col("seconds") > 0, F.col(n) / F.col("seconds")).alias(f"{n}_per_second") for n in kinds])


def dirty(writes: DataFrame) -> DataFrame:
    """What a group commit has to sync: each (device, inode) once, with its number of writes."""
    return writes.groupBy("device", "inode").agg(F.count("*").alias("writes"))

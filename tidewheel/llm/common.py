"""What the operators share: reading tables, cutting lineage, shipping this code to executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.runtime import shared_folder, ship

#: The white space of every contract here: \x20 and \x09-\x0D.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def over_batches(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors.  What a task has allocated goes back to the system when it ends: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def utf8(text: str = "text") -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def with_fields(first: str, df: DataFrame, names: Iterable[str], last: str) -> T.StructType:
    """A schema: fields as DDL, columns of ``df``, fields as DDL."""
    parse = lambda ddl: list(T.StructType.fromDDL(ddl).fields) if ddl else []
    return T.StructType([*parse(first), *(df.schema[c] for c in names), *parse(last)])

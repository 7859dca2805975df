"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.bpe import bpe_encode
from tidewheel.llm.chat import ROTATE_SQL, rotate, with_text_spans
from tidewheel.llm.common import table
from tidewheel.llm.forest import nearest
from tidewheel.llm.langid import identify
from tidewheel.llm.linededup import LINES_SQL, dedup_lines, digest
from tidewheel.llm.mixing import MIX_SQL, mix
from tidewheel.llm.multiset import fingerprint_and_edit
from tidewheel.llm.sharding import shard
from tidewheel.llm.simhash import simhash_components
from tidewheel.llm.toxicity import toxicity


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text_spans(rotate(table(spark, sf_dir, "conversations")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op5_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_and_edit(table(spark, sf_dir, "documents"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, keep="none"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("n_taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_forest": op4_forest,
    "op5_multiset": op5_multiset,
    "op6_linededup": op6_linededup,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}

SQL: dict[str, str] = {"op1_chat": ROTATE_SQL, "op6_linededup": LINES_SQL, "op9_mixing": MIX_SQL}

"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents.  All stages but the last
return the columns of their input.  Rows may lack any value; see the operators for what that means.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, linededup, mixing, near, toxicity
from tidewheel.runtime import remove, shared_folder

#: SQL can't express the learned, hashed and tokenised stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; labels are learned outside the held-out fold."""
    models = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return toxicity.score(rows, models, carry=("row",)).filter(F.col("score") < 0.5).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 or more documents have stay in the first of them only; n_chars follows the text.

    The first occurrence stays, so that a text with many copies reaches the next stages once.
    """
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    kept = linededup.dedup_lines(rows, min_docs=10, keep="first", carry=("row",))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id, whether the others have ids or not.

    Near copies share four fifths of their five-word shingles (exact Jaccard of 0.8 or more).
    """
    return near.drop_near_copies(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    taken = mixing.mix(rows, carry=("row",)).filter("n_taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_taken")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document."""
    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

"""From raw documents to token ids: quality rules, near duplicates, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages 1 to 3 return the columns of ``documents``; the last one
returns doc_id, lang, source, n_tokens, ids, and whether decoding gives the text again.

Cases, as in the operators: a null or empty text fails the quality rules; rows with equal id and text become one; a null id is kept; tables without
rows pass through; other columns of ``documents`` go along up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import bpe, decontam, quality, simhash
from pixelquarry.llm.queries import RANKS
from pixelquarry.session import shared_folder

#: Rows that go to Python at once. Texts are long: the usual ten thousand of them, their ids and the texts decoded again would take some 300 MB a task.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    bounded_batches(spark)
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash fingerprints by a trie self-join, verified at similarity 0.8 of five-word shingles, and an exact search for what they miss."""
    bounded_batches(spark)
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    bounded_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    encode, decode = bpe.codec_functions(spark, RANKS, public_tokenizers.PATTERN)
    coded = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), encode("text").alias("ids"))
    same = decode("ids") == F.col("text").cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("decoded_equal"))


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("tokens", tokens_stage)]

#: Suffix arrays, SimHash classes and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

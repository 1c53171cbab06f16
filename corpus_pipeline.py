"""A corpus in five steps: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolk.llm.linededup import WHITE, delete_repeated_lines
from gridfolk.llm.minhash import drop_near_duplicates
from gridfolk.llm.mixing import mix_sources
from gridfolk.llm.packing import pack_documents
from gridfolk.llm.quality import keep_good
from gridfolk.llm.staging import clear_staged, own_tables, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; a document of which nothing is left goes. n_chars follows the text."""
    cleaned = delete_repeated_lines(docs).filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(WHITE)) != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle_words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn at the square root of their sizes; a document drawn n times is there n times."""
    return mix_sources(docs, alpha=0.5, seed=1).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokenizers and CRC-32 are not in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet to the shared folder and read again by the next.

    What a stage wrote for itself or read is deleted once its own result is
    written; the last stage's tables stay for whoever reads the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables() as tables:
        for _, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir))
            clear_staged(spark, tables, but_last=True)
        return STAGES[-1][1](spark, docs, sf_dir)

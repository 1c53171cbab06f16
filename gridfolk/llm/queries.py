"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .licenses import scan_licences
from .linededup import delete_repeated_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .negatives import hard_negatives
from .packing import pack_documents
from .quality import judge_quality
from .sharding import shard_documents
from .squares import pack_windows
from .tokenids import token_files
from .trie import prefix_trie, rebuilt
from .urlrules import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at the square root of their sizes, as many draws as documents."""
    return mix_sources(table(spark, sf_dir, "documents"), alpha=0.5, seed=1).select("doc_id", "source", "lang", "text", "copy", "n_copies", "shuffle_key")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_units", "n_removed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), end_id=1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(table(spark, sf_dir, "documents"), capacity=4096, end_id=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"), label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"), every=20, most=4))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_near_duplicates, op3_url_rules, op4_byte_shards, op5_line_dedup, op6_quality_rules,
        op7_licence_scan, op8_nearest_vectors, op9_token_files, op10_best_fit_packing, op11_window_packing, op12_hard_negatives,
        op13_prefix_trie,
    )
}

"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are dealt by ranges of the order, so partition p holds what comes before
partition p + 1. The totals of the partitions (one row each) give where a
partition begins in the whole; a running sum inside gives where a row does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def prefix_sums(rows: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Add ``before`` (sizes of all earlier rows), ``row`` (their number) and ``total``.

    ``order`` should name columns that tell rows apart; tied rows come in any
    order. Null sizes count as 0, null order values come first.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    begins, bytes_before, rows_before = [], 0, 0
    # One row for each shuffle partition, whatever the number of rows.
    for part, n_bytes, n_rows in dealt.groupBy("_part").agg(F.sum("_size"), F.count("*")).orderBy("_part").collect():
        begins.append((part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + n_bytes, rows_before + n_rows
    offsets = F.broadcast(spark.createDataFrame(begins, "_part int, _bytes long, _rows long"))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy("_part").orderBy(*order)
    local = dealt.withColumns({"_b": F.coalesce(F.sum("_size").over(earlier), F.lit(0)), "_r": F.row_number().over(number) - 1})
    return (
        local.join(offsets, "_part")
        .withColumns({"before": F.col("_b") + F.col("_bytes"), "row": F.col("_r") + F.col("_rows"), "total": F.lit(bytes_before).cast("long")})
        .drop("_part", "_size", "_b", "_r", "_bytes", "_rows")
    )


def shard_of(before: Column, size: Column, total: Column, shards: int) -> Column:
    """The equal cut of the total that holds the middle of the row."""
    middle = (2 * before + size) * shards
    return F.when(total > 0, F.least(F.lit(shards - 1), F.floor(middle / (2 * total)))).otherwise(0).cast("int")


def balanced_shards(rows: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1, contiguous in the order) and ``slot`` (gapless from 0 in the shard).

    Shard sizes differ from the mean by at most the largest row. Repeated
    rows are rows like any other; null and zero sizes take a slot, too. With
    fewer rows than shards, some shards stay empty. Wide columns are better
    joined on afterwards: everything in ``rows`` is moved once or twice.
    """
    placed = prefix_sums(rows, size, order)
    at = F.coalesce(F.col(size).cast("long"), F.lit(0))
    placed = placed.withColumn("shard", shard_of(F.col("before"), at, F.col("total"), shards))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("_first")))  # at most ``shards`` rows
    return placed.join(firsts, "shard").withColumn("slot", F.col("row") - F.col("_first")).drop("before", "row", "total", "_first")


def document_sizes(docs: DataFrame, extra: int = 16) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text, null: none, plus ``extra``) and ``text_crc32`` (unsigned; null text as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Deal whole documents to shards in ``doc_id`` order.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot and
    grown_shard (null: only keyed laws can grow in place). Only ids, sizes and
    checksums are shuffled. Null ids come first, equal ids are ordered by
    checksum; an empty table gives an empty table.
    """
    dealt = balanced_shards(document_sizes(docs), "size", ["doc_id", "text_crc32", "size"], shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents to ``path/shard=N``, in slot order. Documents need distinct ids here."""
    slots = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    docs.drop("shard", "slot").join(slots, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

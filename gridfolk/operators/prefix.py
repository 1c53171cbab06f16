"""Running sums over a whole table in the order of any columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    context, path = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not path and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (path or context.getCheckpointDir()).rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, in the partitions and the order they have now."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def running(rows: DataFrame, size: str, order: list[str], within: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``offset``: the sizes of all earlier rows (of the same group). Null sizes count as 0, tied rows come in any order.

    Rows are dealt to ranges of the order, so that each task has a stretch of
    it, whatever the keys are and however large a group is. The totals of the
    ranges, a row for each range and each group in it, say what comes before
    a range; a running sum inside says the rest.
    """
    within = within or []
    keys = [*within, *order]
    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    dealt = sized.repartitionByRange(ranges, *keys) if ranges else sized.repartitionByRange(*keys)
    dealt = cut(dealt.sortWithinPartitions(*keys)).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *within).agg(F.sum("_size").alias("_total"))
    begins = totals.select(F.col("_part").alias("_of"), *(F.col(c).alias(f"_g_{c}") for c in within), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_begin"))
    begins = begins if within else F.broadcast(begins)  # a row for each range
    inside = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_of")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(begins, same)
    return placed.select(*rows.columns, (F.col("_begin") + F.col("_inside")).alias("offset"))

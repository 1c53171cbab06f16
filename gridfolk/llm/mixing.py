"""Mix sources to target weights by Poisson replication.

A source with n documents and a target of t draws has the mean repetition
rate t / n. A hash of the document gives a uniform number; the inverse of the
Poisson distribution at that number says how often the document appears. The
same document, seed and rate always give the same count, on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many sources' rates may be broadcast; with more, the join is a plain one, which AQE splits where it is skewed.
BROADCAST_SOURCES = 20_000


def hashed_number(hex_digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an MD5, as a long; null parts count as empty text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, hex_digits), 16, 10).cast("long")


def range_of(shuffle_key: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges a key of 60 bits lies in."""
    return F.shiftright(F.shiftright(shuffle_key, 30) * parts, 30).cast("int")


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, draws: int | None = None, source: str = "source") -> DataFrame:
    """``_source``, ``n_docs`` and ``rate``, one row for each source.

    ``weights`` maps sources (null as None) to weights of any sum; sources
    that it doesn't name get 0. Without it, a source of n documents weighs
    n ** alpha. ``draws`` is the expected number of documents drawn; as many
    as there are by default.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("_weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        kind = T.StructType([T.StructField("_s", docs.schema[source].dataType), T.StructField("_weight", T.DoubleType())])
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], kind)
        weighed = counts.join(F.broadcast(given), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0.0, ["_weight"])
    whole = weighed.agg(F.sum("_weight").alias("_sum"), F.sum("n_docs").alias("_all"))
    share = F.when(F.col("_sum") > 0, F.col("_weight") / F.col("_sum")).otherwise(0.0)
    wanted = F.lit(draws) if draws is not None else F.col("_all")
    return weighed.crossJoin(F.broadcast(whole)).select("_source", "n_docs", (share * wanted / F.col("n_docs")).alias("rate"))  # the right side is one row


def with_distribution(rates: DataFrame) -> DataFrame:
    """Add ``cdf``: the Poisson distribution of each rate, as far as doubles tell it from 1.

    Terms are summed as logarithms, so large rates don't underflow; the array
    has about rate + 12 * sqrt(rate) + 24 entries.
    """
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    terms = rates.withColumn("k", F.explode(F.sequence(F.lit(0), top)))
    upto = Window.partitionBy("_source", "n_docs", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    log_power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.log("rate"))
    terms = terms.withColumn("_log", log_factorial).withColumn("_p", F.when(F.col("rate") > 0, F.exp(log_power - F.col("rate") - F.col("_log"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    terms = terms.withColumn("_upto", F.sum("_p").over(upto))
    listed = terms.groupBy("_source", "n_docs", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "_upto"))).alias("_listed"))
    return listed.select("_source", "rate", F.transform("_listed", lambda x: x["_upto"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, draws: int | None = None, seed: int = 1, source: str = "source", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Replicate every document by its Poisson count and shuffle all copies.

    Adds ``copy`` (1 to ``n_copies``), ``n_copies`` and ``shuffle_key``; rows
    come out dealt by ranges of the key and sorted by it, so files in order
    are a global shuffle. Keys are spread evenly, so the ranges are ``parts``
    equal ones (as many as the session has shuffle partitions, by default)
    and no sample is drawn to find them. Null sources are a source of their own. Rows with
    equal or null ids share one draw and each get that many copies. Text may
    be null, empty or long. An empty table, or weights that sum to 0, give an
    empty result. Columns already named like the three are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    rates = with_distribution(source_rates(docs, weights, alpha, draws, source))
    few = rates.take(BROADCAST_SOURCES + 1)
    if len(few) <= BROADCAST_SOURCES:
        rates = spark.createDataFrame(few, rates.schema)
    uniform = hashed_number(13, F.lit(seed), F.lit("count"), F.col(key)) / F.lit(float(16**13))
    rates = rates.select(F.col("_source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"))
    rates = F.broadcast(rates) if len(few) <= BROADCAST_SOURCES else rates
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_u", uniform)
    drawn = drawn.withColumn("n_copies", F.size(F.filter("_mix_cdf", lambda c: c <= F.col("_mix_u")))).filter("n_copies > 0")
    drawn = drawn.drop("_mix_source", "_mix_cdf", "_mix_u")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", hashed_number(15, F.lit(seed), F.lit("order"), F.col(key), F.col("copy")))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionById(parts, range_of(F.col("shuffle_key"), parts)).sortWithinPartitions("shuffle_key", key, "copy")

"""Tables by unit or by person, and readers that open only what they need."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.world import World

#: Tables that are kept by person, too.
BY_PERSON = ("population", "members", "activities")


def write_shard(rows: DataFrame, path: str, key: str = "geo_unit_id", within: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> int:
    """Files clustered by the key, and ``path_index`` of which files hold a key's rows; returns how many rows there are.

    ``within`` orders the rows of a key and lets Spark cut a large one into
    several files; ``ids`` get bloom filters. Keys without rows write nothing.
    """
    seen = Observation()
    dealt = rows.repartitionByRange(key, *within).sortWithinPartitions(key, *within)
    writer = dealt.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    files = rows.sparkSession.read.parquet(path).select(F.col(key).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    index = files.groupBy("key", "file").agg(F.min("row").alias("first_row"), F.count("*").alias("rows"))
    index.repartitionByRange("key", "file").sortWithinPartitions("key", "file").write.mode("overwrite").parquet(f"{path}_index")
    return seen.get["rows"]


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """key, file, first_row, rows: a row for each file that has rows of a key."""
    return spark.read.parquet(f"{path}_index")


def _of_keys(rows: DataFrame, column: str, keys: Iterable | DataFrame) -> DataFrame:
    if isinstance(keys, DataFrame):
        return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    return rows.filter(F.col(column).isin(list(keys)))


def shard_files(spark: SparkSession, path: str, keys: Iterable | DataFrame) -> list[str]:
    """The files that hold rows of some keys: a list of them, or a table of one column."""
    found = _of_keys(shard_index(spark, path), "key", keys).select("file").distinct().collect()
    return sorted(f"{path}/{x['file']}" for x in found)


def read_shard(spark: SparkSession, path: str, keys: Iterable | DataFrame, key: str = "geo_unit_id") -> DataFrame:
    """The rows of some keys. Only their files are opened, and for a list of keys only row groups that can hold them."""
    keys = keys if isinstance(keys, DataFrame) else list(keys)
    files = shard_files(spark, path, keys)
    return _of_keys(spark.read.parquet(*files), key, keys) if files else spark.read.parquet(path).limit(0)


def presence_of(index: DataFrame) -> DataFrame:
    """Units that have rows, with how many, from a shard's index."""
    return index.groupBy(F.col("key").alias("geo_unit_id")).agg(F.sum("rows").alias("rows"))


def write_by_person(world: World, path: str, name: str, buckets: int = 64) -> list[str]:
    """Tables ``name_population`` and so on in the session's catalog, bucketed and sorted by person; returns their names.

    Joins by person between them, with homes, or of ids with them move
    nothing but the ids.
    """
    written = []
    for table in BY_PERSON:
        if table in world:
            writer = world[table].write.mode("overwrite").option("path", f"{path}/{table}").option("parquet.bloom.filter.enabled#person_id", "true")
            writer.bucketBy(buckets, "person_id").sortBy("person_id").saveAsTable(f"{name}_{table}")
            written.append(f"{name}_{table}")
    return written


def by_person(world: World, name: str) -> World:
    """The world with the tables of :func:`write_by_person` in place of its own."""
    spark = world["population"].sparkSession
    return world.with_tables(**{t: spark.table(f"{name}_{t}") for t in BY_PERSON if spark.catalog.tableExists(f"{name}_{t}")})

"""The geography tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geo_closure(geo_units: DataFrame) -> DataFrame:
    """geo_id, level, ancestor_id: each unit with itself and every ancestor, whatever the depth between them.

    One join of the units with themselves for each level but one; a unit
    gathers its ancestors on the way up. The tree is small beside all other
    tables.
    """
    up = geo_units.select(F.col("geo_id").alias("_id"), F.col("level").alias("_level"), F.col("parent_id").alias("_parent"))
    link = lambda level, unit: F.array(F.struct(F.col(level).alias("level"), F.col(unit).alias("ancestor_id")))
    rows = geo_units.select("geo_id", link("level", "geo_id").alias("_line"), F.col("parent_id").alias("_next"))
    for _ in range(max(0, geo_units.select("level").distinct().count() - 1)):
        longer = F.when(F.col("_id").isNotNull(), F.concat("_line", link("_level", "_id"))).otherwise(F.col("_line"))
        rows = rows.join(up, F.col("_next") == F.col("_id"), "left").select("geo_id", longer.alias("_line"), F.col("_parent").alias("_next"))
    return rows.select("geo_id", F.inline("_line"))


def children_by_people(geo_units: DataFrame, panel: DataFrame) -> DataFrame:
    """Every unit under its parent, with its people (0 without any): sort by parent, people falling, id to list siblings."""
    people = panel.select(F.col("geo_id").alias("_id"), "people")
    rows = geo_units.join(people, F.col("geo_id") == F.col("_id"), "left")
    like_id = F.coalesce(F.col("name").rlike("^[A-Z]\\d{6,}$") | (F.col("name") == F.col("geo_id").cast("string")), F.lit(True))
    return rows.select("parent_id", "geo_id", "level", "name", like_id.alias("name_is_id"), F.coalesce("people", F.lit(0)).alias("people"))


def units_per_level(geo_units: DataFrame, levels: DataFrame) -> DataFrame:
    """level, name (``L`` and the number without a registered one), units; coarse to fine."""
    named = levels.select(F.col("code").alias("level"), "label")
    return geo_units.groupBy("level").agg(F.count("*").alias("units")).join(F.broadcast(named), "level", "left").select("level", F.coalesce("label", F.concat(F.lit("L"), "level")).alias("name"), "units").orderBy("level")

"""Disjoint replicas of a world, for tests at scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.world import World

SPACING = 1.15


def replicas(target: int, people: int) -> int:
    return max(1, -(-target // max(1, people)))


def rebased(column: Column, stride: int) -> Column:
    """An id of replica ``_r``; negative ids mean absent and stay."""
    return F.when(column < 0, column).otherwise(column + F.col("_r") * stride)


def each_replica(rows: DataFrame, k: int) -> DataFrame:
    """All rows once for every replica; the numbers are generated row by row, without a join."""
    return rows.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))


def shifted(column: str, least: float, most: float, across: bool, columns: int) -> Column:
    """Replicas stand on a square grid, 1.15 times the span apart (a span of 0 counts as 1)."""
    span = (most - least) or 1.0
    step = F.col("_r") % columns if across else F.floor(F.col("_r") / columns)
    return (F.col(column) + step * (span * SPACING)).cast("float")


def replicate(world: World, target: int) -> World:
    """K replicas, K * people >= target: ids move by stride, coordinates on a grid, ranks by the type's size; the rest is copied.

    Strides are one more than the largest id, so replicas never meet even
    where ids have gaps.
    """
    stride = lambda name, key: (world[name].agg(F.max(key)).first()[0] or 0) + 1
    k = replicas(target, world["population"].count())
    people, venues, units = stride("population", "person_id"), stride("venues", "venue_id"), stride("geo_units", "geo_id")
    box = world["geo_units"].agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    columns = math.ceil(math.sqrt(k))
    moved = {"lat": shifted("lat", box[0], box[1], False, columns), "lon": shifted("lon", box[2], box[3], True, columns)} if box[0] is not None else {}
    ids = {"person_id": people, "venue_id": venues, "geo_unit_id": units, "geo_id": units}
    out = {}
    for name in ("geo_units", "population", "venues", "subsets", "members", "activities", "legs"):
        if name not in world.tables:
            continue
        table = world[name]
        changes = {c: rebased(F.col(c), s) for c, s in ids.items() if c in table.columns}
        if "parent_id" in table.columns:
            changes["parent_id"] = rebased(F.col("parent_id"), units if name == "geo_units" else venues)
        if name == "population":
            changes |= {c: F.transform(f"`{c}`", lambda x: x + F.col("_r") * people) for c in world.relations()}
        if name == "subsets":
            changes["members"] = F.transform("members", lambda x: x + F.col("_r") * people)
        if "lat" in table.columns:
            changes |= moved
        rows = each_replica(table, k)
        if name == "venues":
            counts = F.broadcast(table.filter("type_code is not null").groupBy("type_code").agg(F.count("*").alias("_type_n")))  # a row for each type
            rows = rows.join(counts, "type_code", "left")
            changes["rank_in_type"] = F.col("rank_in_type") + F.col("_r") * F.coalesce("_type_n", F.lit(0))  # no type, no rank to move
        if "row_pos" in table.columns:
            changes["row_pos"] = F.col("row_pos") + F.col("_r") * ((table.agg(F.max("row_pos")).first()[0] or 0) + 1)
        out[name] = rows.withColumns(changes).select(*table.columns)
    return world.with_tables(**out)


def relation_csr(rows: DataFrame, column: str) -> DataFrame:
    """person_id, pos, value of adjacency lists given as JSON texts; bad texts are empty lists."""
    return rows.select("person_id", F.posexplode(F.from_json(F.col(column), "array<bigint>")).alias("pos", "value"))

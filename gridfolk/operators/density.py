"""How many people and venues each hexagon holds, at several resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import valid_point
from ..functions.display import color_stops
from ..functions.hexgrid import RESOLUTIONS, cell, parent, plane
from ..sources.world import World


def weighted_points(world: World) -> DataFrame:
    """layer, lat, lon, weight: units weigh as many as live there, venues 1 each; a venue without a valid place is at its unit's."""
    units = world["geo_units"].select(F.col("geo_id").alias("geo_unit_id"), F.col("lat").alias("unit_lat"), F.col("lon").alias("unit_lon"))
    people = world["population"].groupBy("geo_unit_id").agg(F.count("*").alias("weight")).join(units, "geo_unit_id").select(F.lit("people").alias("layer"), F.col("unit_lat").alias("lat"), F.col("unit_lon").alias("lon"), "weight")
    own = valid_point(F.col("lat"), F.col("lon"))
    venues = world["venues"].select("geo_unit_id", "lat", "lon").join(units, "geo_unit_id", "left")
    venues = venues.select(F.lit("venues").alias("layer"), F.when(own, F.col("lat")).otherwise(F.col("unit_lat")).alias("lat"), F.when(own, F.col("lon")).otherwise(F.col("unit_lon")).alias("lon"), F.lit(1).cast("long").alias("weight"))
    return people.unionByName(venues).filter(valid_point(F.col("lat"), F.col("lon")))


def finest_density(points: DataFrame) -> DataFrame:
    """layer, q, r, count at the finest resolution."""
    x, y = plane(F.col("lat").cast("double"), F.col("lon").cast("double"))
    q, r = cell(F.col("_x"), F.col("_y"), RESOLUTIONS[-1])
    return points.withColumn("_x", x).withColumn("_y", y).groupBy("layer", q.alias("q"), r.alias("r")).agg(F.sum("weight").alias("count"))


def density_pyramid(finest: DataFrame, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """layer, res, q, r, count: coarser cells are summed from the finest ones, never from rows again, all in one go."""
    cells = [(res, (F.col("q"), F.col("r")) if res == resolutions[-1] else parent(F.col("q"), F.col("r"), resolutions[-1], res)) for res in resolutions]
    each = finest.select("layer", "count", F.inline(F.array(*(F.struct(F.lit(res).alias("res"), q.alias("q"), r.alias("r")) for res, (q, r) in cells))))
    return each.groupBy("layer", "res", "q", "r").agg(F.sum("count").alias("count"))


def density_stops(pyramid: DataFrame, n: int = 6) -> DataFrame:
    """layer, res, largest and the counts at which the colours of a ramp stand."""
    top = pyramid.groupBy("layer", "res").agg(F.max("count").alias("largest")).filter("largest > 0")
    return top.withColumn("stops", color_stops(F.col("largest"), n))

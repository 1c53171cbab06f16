"""Web-Mercator tiles as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units along a tile's side.
EXTENT = 4096
#: Zoom at which each density resolution is drawn.
ZOOM_OF = {3: 4, 5: 7, 7: 10, 9: 13}


def world_x(lon: Column, z: Column | int) -> Column:
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z) * EXTENT


def world_y(lat: Column, z: Column | int) -> Column:
    s = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z) * EXTENT


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile along the Hilbert curves of all zooms, smaller zooms first."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), ((F.pow(F.lit(4.0), z).cast("long") - 1) / 3).cast("long").alias("d"))

    def turn(a: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        right, up = (a["x"].bitwiseAND(side) > 0).cast("long"), (a["y"].bitwiseAND(side) > 0).cast("long")
        d = a["d"] + side * side * (3 * right).bitwiseXOR(up)
        fx = F.when((up == 0) & (right == 1), side - 1 - a["x"]).otherwise(a["x"])
        fy = F.when((up == 0) & (right == 1), side - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(up == 0, fy).otherwise(a["x"]).alias("x"), F.when(up == 0, fx).otherwise(a["y"]).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, turn, lambda a: a["d"])

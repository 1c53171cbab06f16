"""Pointy-top hexagons on the Web-Mercator plane with axial coordinates.

Resolutions are seven times coarser in edge per two steps. A coarser cell is
the one that holds the centre of the finer, so every cell has one parent.
Ground area grows with latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coarse to fine, and the edge of the finest hexagon as a share of the world's width.
RESOLUTIONS = (3, 5, 7, 9)
FINEST_EDGE = 1 / 2**17
ROOT3 = math.sqrt(3)


def edge(res: int) -> float:
    return FINEST_EDGE * 7.0 ** ((RESOLUTIONS[-1] - res) // 2)


def plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Mercator coordinates from 0 to 1."""
    s = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    return (lon + 180.0) / 360.0, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def rounded(q: Column, r: Column) -> tuple[Column, Column]:
    """The hexagon of fractional axial coordinates: the cube coordinate farthest from a whole number follows from the others."""
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    fix_q = (dq > dr) & (dq > ds)
    return F.when(fix_q, -rr - rs).otherwise(rq).cast("long"), F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("long")


def cell(x: Column, y: Column, res: int) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon that holds a point."""
    size = edge(res)
    return rounded((ROOT3 / 3 * x - y / 3) / size, (2.0 / 3 * y) / size)


def by_resolution(res: Column, value) -> Column:
    """What ``value`` gives for each resolution, chosen by a column."""
    out = F
    for each in RESOLUTIONS:
        out = out.when(res == each, F.lit(value(each)))
    return out


def _edge(res: int | Column) -> float | Column:
    return edge(res) if isinstance(res, int) else by_resolution(res, edge)


def centre(q: Column, r: Column, res: int | Column) -> tuple[Column, Column]:
    size = _edge(res)
    return size * (ROOT3 * q + ROOT3 / 2 * r), size * 1.5 * r


def ring(q: Column, r: Column, res: int | Column) -> Column:
    """The six corners on the plane."""
    x, y = centre(q, r, res)
    at = [(_edge(res) * math.cos(math.pi / 180 * (60 * k - 30)), _edge(res) * math.sin(math.pi / 180 * (60 * k - 30))) for k in range(6)]
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in at))


def parent(q: Column, r: Column, res: int, coarser: int) -> tuple[Column, Column]:
    """The coarser hexagon of the centre; all grids have one origin and orientation, so axial coordinates just scale."""
    times = float(7 ** ((res - coarser) // 2))
    return rounded(q / times, r / times)

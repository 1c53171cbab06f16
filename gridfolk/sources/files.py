"""Text inputs: CSV of stops and coordinates, GeoJSON features, and the boundary configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import STRATEGIES

LINE_STOPS = "line_id string, position int, node_mgu string, name string"
COORDINATES = "MGU string, latitude double, longitude double"
FEATURES = "type string, crs struct<properties: struct<name: string>>, features array<struct<properties: map<string,string>, geometry: string>>"
FEATURE_LINE = "type string, properties map<string,string>, geometry string"
#: Names of files with a feature a line end so.
LINE_SUFFIXES = (".geojsonl", ".geojsonl.gz", ".jsonl", ".jsonl.gz", ".ndjson", ".ndjson.gz", ".geojsons")


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """UTF-8 with a header, with or without a byte order mark; columns are found by name."""
    wanted = [tuple(c.strip().split(" ")) for c in columns.split(",")]
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    return rows.select(*(F.trim(F.col(f"`{n}`")).try_cast(t).alias(n) for n, t in wanted)).withColumn("row_pos", F.monotonically_increasing_id())


def is_lonlat(crs: Column) -> Column:
    """No CRS, CRS84 and EPSG:4326 are longitude and latitude."""
    up = F.upper(crs)
    return crs.isNull() | (crs == "") | up.contains("CRS84") | up.endswith(":4326")


def read_features(spark: SparkSession, path: str, lines: bool | None = None, crs: str | None = None) -> DataFrame:
    """``source``, ``crs``, ``props`` and ``geometry`` (as text, so it is parsed only where it is wanted).

    One collection is one task's work; for national files use one feature a
    line (``lines``; by default, if the name ends in :data:`LINE_SUFFIXES`).
    ``crs`` says what the coordinates are whatever the file says of itself.
    TopoJSON and other coordinates than longitude and latitude raise.
    """
    lines = path.lower().endswith(LINE_SUFFIXES) if lines is None else lines
    if lines:
        rows = spark.read.schema(FEATURE_LINE).json(path).select(F.col("type"), F.lit(None).cast("string").alias("crs"), F.col("properties").alias("props"), "geometry")
    else:
        read = spark.read.schema(FEATURES).json(path, multiLine=True)
        rows = read.select("type", F.col("crs.properties.name").alias("crs"), F.explode_outer("features").alias("f")).select("type", "crs", F.col("f.properties").alias("props"), F.col("f.geometry").alias("geometry"))
    rows = rows.withColumn("crs", F.coalesce(F.lit(crs).cast("string"), "crs"))
    bad = F.when(F.col("type") == "Topology", F.raise_error(F.lit("TopoJSON is not read; convert it to GeoJSON")).cast("string"))
    bad = bad.when(~is_lonlat(F.col("crs")), F.raise_error(F.concat(F.lit("not longitude and latitude: "), "crs")).cast("string"))
    rows = rows.withColumn("source", bad.otherwise(F.lit(os.path.basename(path)))).filter(F.col("source").isNotNull() & F.col("props").isNotNull())
    return rows.select("source", "crs", F.transform_values("props", lambda _, v: F.coalesce(v, F.lit(""))).alias("props"), "geometry").withColumn("row_pos", F.monotonically_increasing_id())


@dataclass(frozen=True)
class BoundaryLevel:
    """Where the shapes of a level are, which property names their units, how the names are made alike, what the coordinates are (if not what the file says), and whether it has a feature a line (null: by its name)."""

    file: str
    prop: str
    strategy: str
    crs: str | None = None
    lines: bool | None = None


def boundary_levels(path: str) -> dict[str, BoundaryLevel]:
    """Levels of a JSON configuration ``{"levels": {name: {file, prop, strategy, crs?, lines?}}}``; files are relative to it.

    ``strategy`` may be written in any case. Everything that is wrong is told at once.
    """
    home, wrong = os.path.dirname(os.path.abspath(path)), []
    try:
        with open(path, encoding="utf-8-sig") as f:
            given = json.load(f)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    levels = given.get("levels") if isinstance(given, dict) else None
    if not (isinstance(levels, dict) and levels):
        raise ValueError(f"{path} names no levels")

    def checked(level: str, entry, field: str, needed: bool = True) -> str | None:
        value = entry.get(field) if isinstance(entry, dict) else None
        if isinstance(value, str) and value.strip():
            return value.strip()
        if needed or value is not None:
            wrong.append(f"{level}.{field} must be a text" if value is not None else f"{level}.{field} is missing")
        return None

    found = {}
    for level, entry in levels.items():
        file, prop, strategy, crs = (checked(level, entry, f, f != "crs") for f in ("file", "prop", "strategy", "crs"))
        if strategy and strategy.lower() not in STRATEGIES:
            wrong.append(f"{level}.strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
        place = os.path.join(home, file or "")
        if file and not os.path.exists(place):
            wrong.append(f"{level}.file {place} isn't there")
        lines = entry.get("lines") if isinstance(entry, dict) else None
        if not isinstance(lines, bool | None):
            wrong.append(f"{level}.lines must be true or false")
        found[level] = BoundaryLevel(place, prop or "", (strategy or "").lower(), crs, lines)
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return found

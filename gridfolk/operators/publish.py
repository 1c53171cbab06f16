"""Write a world's results for readers by unit, and the manifest that says what is there."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import cleaned
from ..functions.display import match_flag
from ..sources.files import boundary_levels, read_features
from ..sources.world import World, describe
from .density import density_pyramid, finest_density, weighted_points
from .geo import geo_closure, units_per_level
from .inspect import activities_view, home_units, json_properties, members_view, peak_unit_rows, people_view, unit_presence, venues_view
from .match import attach_extents, boundary_extents, matched_features, zoom_bands
from .panel import panel_long, panel_names, panel_people, widened
from .profile import categorical_properties
from .shards import presence_of, shard_index, write_shard
from .tiles import boundary_tiles, clustered, hexagon_tiles, line_tiles, tile_directory, with_tile_id
from .transit import line_geometry, line_venues, lines_geojson, lines_in_world, rider_counts, rider_legs, riders, sample_riders, stop_points, transit_summary

VERSION = 3
#: How rows of one unit are ordered, so that a large unit is several files, and which columns are looked up.
WITHIN = {"population": ("person_id",), "venues": ("venue_id",), "subsets": ("venue_id", "person_id"), "activities": ("person_id", "venue_id")}
LOOKED_UP = {"population": ("person_id",), "venues": ("venue_id",), "subsets": ("person_id",), "activities": ("person_id",)}


def fingerprint(spark: SparkSession, paths: list[str]) -> list[list]:
    """Size and whole-second time of every input file."""
    out = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_timestamp("modificationTime").alias("t"))  # contents aren't read
        out += [list(x) for x in files.orderBy("path").collect()]
    return out


def stored_manifest(spark: SparkSession, out: str) -> dict | None:
    try:
        row = spark.read.text(f"{out}/manifest", wholetext=True).first()
        return json.loads(row[0]) if row else None
    except Exception as e:  # the folder isn't there before the first build
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_manifest(spark: SparkSession, out: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")


def manifest_summary(world: World) -> DataFrame:
    """section, name, value: units of each level and the largest unit of each table."""
    return summary_of(world, peak_unit_rows(world))


def summary_of(world: World, peaks: DataFrame) -> DataFrame:
    """The same where the largest units (container, peak) are known."""
    levels = units_per_level(world["geo_units"], world.registry("geo_levels")).select(F.lit("units").alias("section"), "name", F.col("units").alias("value"))
    return levels.unionByName(peaks.select(F.lit("peak").alias("section"), F.col("container").alias("name"), F.col("peak").alias("value")))


def write_panels(world: World, closure: DataFrame, out: str, extents: DataFrame | None) -> list[str]:
    """The long panel, that of people, and a wide table for each level, with its units' extents where there are any."""
    spark, properties = closure.sparkSession, categorical_properties(world)
    panel_long(world, closure, properties=properties).repartitionByRange("level", "geo_id").write.mode("overwrite").partitionBy("level").parquet(f"{out}/panel")
    panel_people(world, closure).repartitionByRange("level", "geo_id").write.mode("overwrite").partitionBy("level").parquet(f"{out}/people_panel")
    long, people = (spark.read.parquet(f"{out}/{t}") for t in ("panel", "people_panel"))  # the sources aren't read again
    names = panel_names(world, properties, long)
    for level in world.labels_of("geo_levels"):  # a few
        at = F.col("level") == level
        wide = widened(long.filter(at).drop("level"), people.filter(at), names)
        wide = attach_extents(wide, extents.filter(F.col("level") == level).drop("level")) if extents is not None else wide
        wide.repartitionByRange("geo_id").write.mode("overwrite").parquet(f"{out}/panel_wide/level={level}")
    return ["panel", "people_panel", "panel_wide"]


def write_boundaries(spark: SparkSession, world: World, config: str, out: str) -> dict:
    """Extents and tiles of the units that have shapes; returns what each level has of them.

    Levels that the world doesn't have are left out. Shapes may cover a part
    of a level, or nothing of it: the rate is told, and nothing is refused
    for it (:func:`gridfolk.operators.match.poorest_rate` does that for whom
    it matters). Each file is read once.
    """
    codes = {label: code for code, label in world.labels_of("geo_levels").items()}
    known = {name: level for name, level in boundary_levels(config).items() if name in codes}
    parts = None
    for name, level in known.items():
        features = read_features(spark, level.file, level.lines, level.crs)
        extents = boundary_extents(matched_features(world["geo_units"], features, codes[name], level.prop, level.strategy)).withColumn("level", F.lit(codes[name]))
        parts = extents if parts is None else parts.unionByName(extents)
    if parts is None:
        return {}
    parts.write.mode("overwrite").parquet(f"{out}/extents")
    written = spark.read.parquet(f"{out}/extents")
    clustered(with_tile_id(boundary_tiles(written, zoom_bands(world["geo_units"])))).write.mode("overwrite").parquet(f"{out}/boundary_tiles")
    matched, units = written.groupBy("level").agg(F.count("*").alias("matched")), world["geo_units"].groupBy("level").agg(F.count("*").alias("world_units"))
    rate = F.coalesce("matched", F.lit(0)) / F.col("world_units")
    counts = units.join(matched, "level", "left").select("level", "world_units", F.coalesce("matched", F.lit(0)).alias("matched"), rate.alias("rate"), match_flag(rate).alias("flag"))
    found = {x["level"]: x.asDict() for x in counts.collect()}  # a row for each level
    return {name: {k: v for k, v in found[codes[name]].items() if k != "level"} | {"strategy": level.strategy, "prop": level.prop} for name, level in known.items() if codes[name] in found}


def write_transit(world: World, homes: DataFrame, out: str) -> dict:
    """Lines, their features and tiles, riders, chains and a sample of riders; nothing, and an empty summary, without a line that has a geometry."""
    spark, lines = homes.sparkSession, line_venues(world)
    on = riders(world, lines, homes)
    placed = lines_in_world(rider_counts(lines, on), line_geometry(world["line_stops"], world["coord_mgu"], lines))
    if not placed.take(1):
        return {}
    placed.write.mode("overwrite").parquet(f"{out}/lines")
    lines_geojson(placed).select("feature").write.mode("overwrite").text(f"{out}/line_features")  # a feature a line
    cut = with_tile_id(line_tiles(stop_points(spark.read.parquet(f"{out}/lines"))))
    clustered(cut, "line_id", "part").write.mode("overwrite").parquet(f"{out}/line_tiles")
    write_shard(on, f"{out}/riders", "venue_id", ("person_id",), ("person_id",))
    legs = rider_legs(world, lines, homes, typed=True)
    write_shard(legs, f"{out}/chains", "home_geo_unit", ("person_id", "leg_idx"), ("person_id",))
    counted = rider_counts(lines, on)
    sample_riders(counted, on, legs).write.mode("overwrite").parquet(f"{out}/sample_riders")
    return transit_summary(counted, on, legs).first().asDict()


def build(spark: SparkSession, world: World, out: str, sources: list[str] | None = None, drilldown: bool = True, force: bool = False, boundaries: str | None = None, transit: list[str] | None = None) -> dict:
    """All tables of a viewer under ``out``; nothing is done if version, inputs and mode are those of the manifest there.

    ``boundaries`` is a configuration for :func:`boundary_levels`. ``sources``
    and ``transit`` are the files the world was read from; they, the
    configuration and its shapes have marks of their own. While a build is
    under way there is no manifest, so one that fails is done again.
    """
    shapes = [boundaries, *(x.file for x in boundary_levels(boundaries).values())] if boundaries else []
    marks = {"version": VERSION, "sources": fingerprint(spark, sources or []), "boundaries": fingerprint(spark, shapes), "transit": fingerprint(spark, transit or []), "drilldown": drilldown}
    if not force and (old := stored_manifest(spark, out)) and sources and {k: old.get(k) for k in marks} == marks:
        return old
    if ("line_stops" in world) != ("coord_mgu" in world):
        raise ValueError("transit needs both line_stops and coord_mgu")
    write_manifest(spark, out, {})
    began, sections, peaks, counts = time.time(), {"boundary_match": {}, "transit_summary": {}}, None, {}
    closure = geo_closure(world["geo_units"]).persist()
    try:
        if boundaries:
            sections["boundary_match"] = write_boundaries(spark, world, boundaries, out)
        artifacts = ["extents", "boundary_tiles"] if sections["boundary_match"] else []  # perhaps empty tables
        artifacts += write_panels(world, closure, out, spark.read.parquet(f"{out}/extents") if artifacts else None)
    finally:
        closure.unpersist()
    homes = home_units(world["population"])
    views = {"population": lambda: people_view(world, json_properties(world)), "venues": lambda: venues_view(world), "subsets": lambda: members_view(world, homes), "activities": lambda: activities_view(world)}
    for name, view in views.items():
        if name not in world:
            continue
        if drilldown:
            counts[name] = write_shard(view(), f"{out}/{name}", within=WITHIN[name], ids=LOOKED_UP[name])
            artifacts.append(name)
        # A shard's index knows how many rows a unit has; a row of the members' shard is a member, not a subset.
        indexed = drilldown and name != "subsets"
        presence = presence_of(shard_index(spark, f"{out}/{name}")) if indexed else unit_presence(world[name])
        presence.write.mode("overwrite").parquet(f"{out}/{name}_presence")
        peak = spark.read.parquet(f"{out}/{name}_presence").agg(F.lit(name).alias("container"), F.coalesce(F.max("rows"), F.lit(0)).alias("peak"))
        peaks = peak if peaks is None else peaks.unionByName(peak)
    if world.has_coordinates():
        density_pyramid(finest_density(weighted_points(world))).write.mode("overwrite").parquet(f"{out}/density")
        clustered(with_tile_id(hexagon_tiles(spark.read.parquet(f"{out}/density"))), "layer", "q", "r").write.mode("overwrite").parquet(f"{out}/tiles")
        clustered(tile_directory(spark.read.parquet(f"{out}/tiles"))).write.mode("overwrite").parquet(f"{out}/tile_index")
        artifacts += ["density", "tiles", "tile_index"]
    if "line_stops" in world and "legs" in world:
        sections["transit_summary"] = write_transit(world, homes, out)
        artifacts += ["lines", "line_features", "line_tiles", "riders", "chains", "sample_riders"] if sections["transit_summary"] else []
    manifest = marks | sections | {
        "schema": json.loads(describe(world).toJSON().first()), "artifacts": artifacts, "build_seconds": round(time.time() - began, 1),
        "summary": [x.asDict() for x in summary_of(world, peaks).collect()], "rows": counts,  # a row for each level and table
    }
    write_manifest(spark, out, manifest)
    return manifest


def records(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts; NaN becomes null."""
    clean = {f.name: cleaned(F.col(f"`{f.name}`")) for f in rows.schema if f.dataType.typeName() in ("float", "double")}
    return rows.withColumns(clean).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))

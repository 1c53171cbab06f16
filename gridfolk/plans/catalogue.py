"""All registered queries over the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import norm_code, norm_name
from ..functions.display import compact, human_number, humanize, percent, relabel
from ..operators import density, geo, inspect, match, panel, profile, publish, replicate, tiles, transit
from ..operators.prefix import cut
from ..sources.star import star_world
from ..sources.world import World, describe
from .details import ODD_QUERIES, TABLE_QUERIES, WORLD_QUERIES, odd_world, wide_levels
from .details_sql import DETAIL_ORACLES
from .star_sql import ORACLES as STAR_ORACLES
from .tables import TABLE_FILE_QUERIES, TABLE_ORACLES, TABLE_WORLD_QUERIES

__all__ = ["ORACLES", "QUERIES"]


def _people(w: World) -> DataFrame:
    return panel.panel_people(w, geo.geo_closure(w["geo_units"]))


def _long(w: World, family: str) -> DataFrame:
    return panel.panel_long(w, geo.geo_closure(w["geo_units"]), (family,))


def _ids(w: World) -> DataFrame:
    """Everyone who has activities, again and again, and ids that nobody has."""
    ids = w["activities"].select("person_id")
    return ids.unionByName(ids.select((-F.col("person_id") - 1).alias("person_id")))


def _shares(w: World) -> DataFrame:
    closure = cut(geo.geo_closure(w["geo_units"]))
    return panel.shares(panel.panel_long(w, closure), panel.panel_people(w, closure)).withColumn("share", F.round("share", 9))


def _wide(w: World) -> DataFrame:
    """Some columns of every level's wide panel; ids are of one level only."""
    return wide_levels(w).select("geo_id", "people", "mean_age", "sex:male", "sex:female", "venues:company", "occ:company", "occ:train_line", "p:balance_band=low")


def _groups(w: World) -> DataFrame:
    return panel.venue_rows(panel.panel_groups(wide_levels(w)))


def _homes(w: World) -> DataFrame:
    return inspect.home_units(w["population"])


def _riders(w: World) -> DataFrame:
    return transit.riders(w, transit.line_venues(w), _homes(w))


def _counted(w: World) -> DataFrame:
    return transit.rider_counts(transit.line_venues(w), _riders(w))


def _legs(w: World) -> DataFrame:
    return transit.rider_legs(w, transit.line_venues(w), _homes(w))


def _lines(w: World) -> DataFrame:
    return transit.lines_in_world(_counted(w), transit.line_geometry(w["line_stops"], w["coord_mgu"], transit.line_venues(w)))


def _placed(w: World) -> DataFrame:
    lines = transit.line_venues(w)
    return transit.placed_lines(lines, transit.line_geometry(w["line_stops"], w["coord_mgu"], lines))


def _geometry(w: World) -> DataFrame:
    stops = transit.line_geometry(w["line_stops"], w["coord_mgu"], transit.line_venues(w)).select("line_id", F.explode("stops").alias("s"))
    return stops.select("line_id", F.col("s.position").alias("position"), F.col("s.node").alias("node"), F.round("s.lon", 6).alias("lon"), F.round("s.lat", 6).alias("lat"))


def _pyramid(w: World) -> DataFrame:
    return density.density_pyramid(density.finest_density(density.weighted_points(w)))


def _extents(w: World) -> DataFrame:
    return match.boundary_extents(match.matched_features(w["geo_units"], w["features"], 1, "CODE", "code"))


def _panel_extents(w: World) -> DataFrame:
    people = panel.panel_people(w, geo.geo_closure(w["geo_units"])).select("geo_id", "people")  # nations have shapes, others none
    return match.attach_extents(people, _extents(w))


def _boundary_tiles(w: World) -> DataFrame:
    return tiles.boundary_tiles(_extents(w).withColumn("level", F.lit(1)), match.zoom_bands(w["geo_units"]))


def _csr(w: World) -> DataFrame:
    """Offsets of each venue's members within its type."""
    counts = w["members"].groupBy("venue_id").agg(F.count("*").alias("n")).withColumn("kind", F.col("venue_id") % 4)
    return inspect.csr_offsets(counts, "venue_id", "n", "kind")


def _people_json(w: World) -> DataFrame:
    """People with a property of JSON arrays made from their ids, typed over all rows and parsed; blank for every third."""
    k = F.col("person_id")
    made = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("["), (k % 5).cast("string"), F.lit(", "), (k % 7).cast("string"), F.lit("]")))
    named = F.concat(F.lit('["a'), (k % 4).cast("string"), F.lit('"]'))
    tagged = w.with_tables(population=w["population"].withColumns({"tags": made, "names": named}))
    view = inspect.people_view(tagged, inspect.json_properties(tagged))
    total = F.aggregate("tags", F.lit(0).cast("long"), lambda a, x: a + x)
    return view.select("person_id", "sex", "balance_band", F.size("tags").alias("n_tags"), total.alias("tag_sum"), F.array_join("names", ",").alias("names"))


def _csr_expand(w: World) -> DataFrame:
    s = w["subsets"].withColumns({"offset": F.lit(0), "n": F.size("members")})
    flat = w["subsets"].select("venue_id", "subset_index", F.posexplode("members").alias("pos", "value"))
    return inspect.csr_expand(s.select("venue_id", "subset_index", "offset", "n"), flat, ["venue_id", "subset_index"]).select("venue_id", "subset_index", "pos", "value")


def _json_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    listed = F.concat(F.lit("["), (F.col("user_id") % 5).cast("string"), F.lit(","), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    mixed = F.when(F.col("event_id") % 100 == 0, '["x"]').when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
    parts = [profile.json_array_typing(events.select(v.alias("v")), "v").withColumn("source", F.lit(c)) for c, v in (("props", F.col("props")), ("made", listed), ("mixed", mixed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _tile_ids(w: World) -> DataFrame:
    return tiles.tile_index(tiles.hexagon_tiles(_pyramid(w)))


def _replica(w: World, table: str, *columns: str) -> DataFrame:
    return replicate.replicate(w, 2 * w["population"].count() + 1)[table].select(*columns)


def _relabel(w: World) -> DataFrame:
    labels = F.create_map(F.lit("AUTOMOBILE"), F.lit("Cars"), F.lit("BUILDING"), F.lit(""))
    return w["population"].select("person_id", relabel(F.col("mktsegment"), labels).alias("segment"))


def _humanize(w: World) -> DataFrame:
    return w["geo_units"].select("geo_id", humanize(F.lower("name")).alias("name"), norm_code(F.col("name")).alias("code_key"), norm_name(F.col("name")).alias("name_key"))


def _total(price: Column) -> Column:
    """The whole sum of prices, added in whole millionths, so that it is the same in any order; as doubles, if some are no such numbers (NaN, infinite, from 1e22 on)."""
    millionths = price * 1e6
    parts = F.when(F.abs(price) < 1e12, F.floor(millionths + 0.5).cast("decimal(28,0)")).otherwise(millionths.try_cast("decimal(28,0)"))  # long, hence fast, where it can be
    return F.when(F.count(parts) == F.count(price), F.round(F.sum(parts).cast("double") / 1e6)).otherwise(F.round(F.sum(price)))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short total and number of orders of every customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    per = orders.groupBy("o_custkey").agg(_total(F.col("o_totalprice")).alias("total"), F.count("*").alias("n"))
    return per.select("o_custkey", compact(F.col("total")).alias("short"), percent(F.col("n").cast("double"), F.lit(20.0)).alias("pct"), human_number(F.concat(F.col("n").cast("string"), F.lit("k"))).alias("human"))


def _manifest(w: World) -> DataFrame:
    return publish.manifest_summary(w)


_WORLD = {
    "geo_closure": lambda w: geo.geo_closure(w["geo_units"]),
    "geo_children_by_people": lambda w: geo.children_by_people(w["geo_units"], _people(w)),
    "units_per_level": lambda w: geo.units_per_level(w["geo_units"], w.registry("geo_levels")),
    "panel_people": _people,
    "panel_age_bands": lambda w: panel.panel_groups(_people(w).withColumn("geo_id", F.col("level") * 100_000 + F.col("geo_id"))).select("geo_id", "item", "value"),
    "panel_sex": lambda w: _long(w, "sex"),
    "panel_properties": lambda w: _long(w, "p"),
    "panel_venues": lambda w: _long(w, "venues"),
    "panel_occupancy": lambda w: _long(w, "occ"),
    "panel_wide": _wide,
    "panel_venue_groups": _groups,
    "panel_shares": _shares,
    "panel_extents": _panel_extents,
    "property_profile": lambda w: profile.property_profile(w["population"], w.properties()),
    "world_schema": lambda w: describe(w).select(F.array_join("geo_levels", ",").alias("geo_levels"), F.array_join("properties", ",").alias("properties"), F.array_join("leg_fields", ",").alias("leg_fields"), "has_coordinates", F.lit(w["population"].count()).alias("people")),
    "people_view": inspect.people_view,
    "people_view_json": _people_json,
    "venues_view": lambda w: inspect.venues_view(w).withColumns({c: F.round(F.coalesce(F.nanvl(F.col(c), F.lit(-999.0)), F.lit(-999.0)).cast("double"), 3) for c in ("lat", "lon")}),
    "members_view": lambda w: inspect.members_view(w, _homes(w)),
    "members_without_homes": lambda w: inspect.members_view(w, None).groupBy("home_geo_unit").agg(F.count("*").alias("n")),
    "activities_view": inspect.activities_view,
    "people_by_ids": lambda w: inspect.people_by_ids(w, _ids(w)),
    "activities_by_ids": lambda w: inspect.activities_by_ids(w, _ids(w)),
    "venue_member_attributes": inspect.venue_member_attributes,
    "unit_presence": lambda w: inspect.unit_presence(w["activities"]),
    "peak_unit_rows": inspect.peak_unit_rows,
    "csr_offsets": _csr,
    "csr_expand": _csr_expand,
    "match_report": lambda w: match.match_report(w["geo_units"], w["features"]).withColumn("rate", F.round("rate", 9)),
    "match_unmatched": lambda w: match.unmatched(w["geo_units"], w["features"]),
    "key_collisions": lambda w: match.collisions(w["geo_units"].withColumn("name", F.regexp_extract("name", "^([^_/]+)", 1)), "name"),
    "boundary_extent": _extents,
    "boundary_tiles": _boundary_tiles,
    "zoom_bands": lambda w: match.zoom_bands(w["geo_units"]),
    "density_finest": lambda w: density.finest_density(density.weighted_points(w)),
    "density_pyramid": _pyramid,
    "density_color_stops": lambda w: density.density_stops(_pyramid(w)).select("layer", "res", "largest", F.array_join(F.transform("stops", lambda x: x.cast("string")), ",").alias("stops")),
    "tile_assign": lambda w: tiles.hexagon_tiles(_pyramid(w)).select("z", "x", "y", "layer", "res", "q", "r", "count"),
    "tile_features": lambda w: tiles.hexagon_features(tiles.hexagon_tiles(_pyramid(w))).select("z", "x", "y", "layer", F.size("features").alias("n"), F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + f["count"]).alias("people")),
    "tile_cover": lambda w: tiles.covered(_extents(w), F.lit(9)).select("geo_id", "z", "x", "y"),
    "tile_hilbert_index": _tile_ids,
    "tile_stats": lambda w: tiles.tile_stats(tiles.hexagon_tiles(_pyramid(w))),
    "line_venues": lambda w: transit.line_venues(w).drop("row_pos"),
    "line_geometry": _geometry,
    "line_rider_counts": lambda w: _counted(w).drop("row_pos"),
    "lines_in_world": lambda w: _lines(w).select("line_id", "venue_id", "mode", "rider_count", F.size("stops").alias("n_stops")),
    "lines_geojson": lambda w: transit.lines_geojson(_lines(w)),
    "line_tiles": lambda w: tiles.line_tiles(transit.stop_points(_placed(w))).select("line_id", "venue_id", "z", "x", "y", "part", F.to_json("points").alias("points")),
    "line_lengths": lambda w: transit.segment_lengths(_placed(w)).withColumn("length", F.round("length", 6)),
    "top_lines": lambda w: transit.top_lines(_counted(w)),
    "sample_riders": lambda w: transit.sample_riders(_counted(w), _riders(w), _legs(w)),
    "shared_riders": lambda w: transit.shared_riders(_riders(w), [2, 3]),
    "rider_legs": _legs,
    "rider_leg_minutes": lambda w: transit.leg_durations(_legs(w)).groupBy("line_id").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("legs")),
    "journey_units": lambda w: transit.journey_units(_legs(w), transit.line_venues(w)).select("person_id", F.array_join(F.transform("units", lambda x: x.cast("string")), ",").alias("units")),
    "journey_points": lambda w: transit.journey_points(transit.journey_units(_legs(w), transit.line_venues(w)), w["geo_units"]).select("person_id", "step", "geo_id", "name", "role"),
    "transit_summary": lambda w: transit.transit_summary(_counted(w), _riders(w), _legs(w)),
    "replicate_population": lambda w: _replica(w, "population", "person_id", "geo_unit_id", "sex_code", "mktsegment"),
    "replicate_ranks": lambda w: _replica(w, "venues", "venue_id", "geo_unit_id", "type_code", "parent_id", "rank_in_type"),
    "replicate_units": lambda w: _replica(w, "geo_units", "geo_id", "level", "parent_id", "name").withColumn("name", F.lower("name")),
    "relabel_codes": _relabel,
    "humanize_tokens": _humanize,
    "page_riders": lambda w: inspect.page(_riders(w), ["person_id"], "venue_id", 1).select("venue_id", "person_id"),
    "records_json": lambda w: publish.records(inspect.venues_view(w).select("venue_id", "type", F.col("lat").cast("double").alias("lat"))),
    "manifest_summary": _manifest,
}


def _on_world(query, change=lambda w: w):
    return lambda spark, sf_dir: query(change(star_world(spark, sf_dir)))


QUERIES = {name: _on_world(query) for name, query in (_WORLD | WORLD_QUERIES | TABLE_WORLD_QUERIES).items()}
QUERIES |= {name: _on_world(query, odd_world) for name, query in ODD_QUERIES.items()}
QUERIES |= {"json_array_typing": _json_typing, "format_numbers": _numbers} | TABLE_QUERIES | TABLE_FILE_QUERIES
ORACLES = STAR_ORACLES | DETAIL_ORACLES | TABLE_ORACLES

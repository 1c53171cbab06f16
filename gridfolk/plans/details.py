"""Queries over rows that the clean tables don't have, and over what the main queries leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import cell_list, cell_number, cell_text, identifier, number, relabel_each
from ..operators import density, geo, inspect, match, panel, replicate, tiles, transit
from ..operators.prefix import cut
from ..sources.star import star_world
from ..sources.world import World, members_of, units_rows

#: Added to ids and places in file so that they are new.
AWAY = 1_000_000_000


def odd_world(w: World) -> World:
    """The same world with repeated venues, unknown codes, venues and people, ages that are none, blanks, and stops without or with two places."""
    person, venue, stop = F.col("person_id"), F.col("venue_id"), F.col("position")
    again = w["venues"].filter(venue % 5 == 0).withColumns({"geo_unit_id": F.lit(1000).cast("long"), "type_code": F.when(venue % 2 == 0, 1).otherwise(99), "name": F.lit(None).cast("string"), "row_pos": F.col("row_pos") + AWAY})
    venues = w["venues"].withColumn("type_code", F.when(venue % 7 == 0, 99).otherwise(F.col("type_code"))).unionByName(again)
    age = F.when(person % 10 == 0, float("nan")).when(person % 13 == 0, -F.col("age") - 1).otherwise(F.col("age")).cast("float")
    population = w["population"].filter(person % 11 != 0).withColumns({
        "age": age, "sex_code": F.when(person % 9 == 0, 5).otherwise(F.col("sex_code")),
        "mktsegment": F.when(person % 8 == 0, "").when(person % 6 == 0, None).otherwise(F.col("mktsegment")),
    })
    members = w["members"].withColumn("subset_name", F.when(venue % 2 == 0, "own"))
    activities = w["activities"].withColumns({"activity_idx": F.when(venue % 3 == 0, 77).otherwise(F.col("activity_idx")), "venue_id": F.when(person % 4 == 0, venue + AWAY).otherwise(venue)})
    number_of = F.floor(F.col("row_pos") / 4)
    nowhere = ((stop == 1) & (number_of % 4 == 2)) | ((stop > 0) & (number_of % 12 == 3))
    line_stops = w["line_stops"].withColumn("node_mgu", F.when(nowhere, "nowhere").otherwise(F.col("node_mgu")))
    twice = w["coord_mgu"].filter(F.col("row_pos") % 10 == 0).withColumns({"latitude": F.col("latitude") + 1, "row_pos": F.col("row_pos") + AWAY})
    return w.with_tables(venues=venues, population=population, members=members, activities=activities, line_stops=line_stops, coord_mgu=w["coord_mgu"].unionByName(twice))


def _odd_people(w: World) -> DataFrame:
    return panel.panel_people(w, geo.geo_closure(w["geo_units"]))


def _odd_long(w: World, *families: str) -> DataFrame:
    return panel.panel_long(w, geo.geo_closure(w["geo_units"]), families)


def _odd_geometry(w: World) -> DataFrame:
    stops = transit.line_geometry(w["line_stops"], w["coord_mgu"], transit.line_venues(w)).select("line_id", F.explode("stops").alias("s"))
    return stops.select("line_id", F.col("s.position").alias("position"), F.col("s.node").alias("node"), F.round("s.lon", 6).alias("lon"), F.round("s.lat", 6).alias("lat"))


def _pyramid_tiles(w: World) -> DataFrame:
    return tiles.hexagon_tiles(density.density_pyramid(density.finest_density(density.weighted_points(w))))


def _rings(w: World) -> DataFrame:
    corners = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["px"], p["py"])), ",")
    return _pyramid_tiles(w).select("z", "x", "y", "layer", "q", "r", corners.alias("ring"))


def _corners(w: World) -> DataFrame:
    sides = ("west", "south", "east", "north")
    return tiles.tile_corners(tiles.tile_index(_pyramid_tiles(w))).select("z", "x", "y", *(F.round(c, 6).alias(c) for c in sides))


def _bounds(w: World) -> DataFrame:
    return tiles.dataset_bounds(density.weighted_points(w)).select(*(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("minx", "miny", "maxx", "maxy", "cx", "cy")))


def _replicas(w: World) -> World:
    return replicate.replicate(w, 2 * w["population"].count() + 1)


def _places(w: World, table: str, key: str) -> DataFrame:
    return _replicas(w)[table].select(key, *(F.round(F.coalesce(F.col(c), F.lit(-999)).cast("double"), 3).alias(c) for c in ("lat", "lon")))


def _friends(w: World) -> DataFrame:
    """Replicas of a relation given as JSON lists; every fourth person's list is broken."""
    person = F.col("person_id")
    listed = F.when(person % 4 == 0, "none").otherwise(F.to_json(F.array(person + 1, person + 2)))
    flat = replicate.relation_csr(w["population"].withColumn("friends", listed), "friends")
    lists = flat.groupBy("person_id").agg(F.array_sort(F.collect_list("value")).alias("friends"))
    people = w["population"].join(lists, "person_id", "left")
    copies = _replicas(w.with_tables(population=people))["population"]
    return copies.select("person_id", F.posexplode("friends").alias("pos", "friend"))


def _slices(w: World) -> DataFrame:
    rest = inspect.csr_slice(F.col("members"), F.lit(1), F.size("members") - 1)
    return w["subsets"].select("venue_id", "subset_index", F.posexplode(rest).alias("pos", "person_id"))


def _labels(w: World) -> DataFrame:
    labels = F.create_map(F.lit("low"), F.lit("Poor"), F.lit("AUTOMOBILE"), F.lit("Cars"), F.lit("mid"), F.lit(""))
    return w["population"].select("person_id", F.array_join(relabel_each(F.array("mktsegment", "balance_band"), labels), "|").alias("labels"))


def _venue_properties(w: World) -> DataFrame:
    """Venues with a property of companies and one of households, given by place within the type; some have none."""
    rank, typed = F.col("rank_in_type"), inspect.venues_view(w).select("venue_id", "type")
    rows = w["venues"].select("venue_id", "rank_in_type").join(typed, "venue_id").filter(F.col("type").isin("company", "household") & (rank % 3 != 0))
    given = rows.select("type", "rank_in_type", F.when(F.col("type") == "company", "kind").otherwise("size").alias("prop"), F.concat(F.lit("v"), (rank % 4).cast("string")).alias("value"))
    view = inspect.venues_view(w.with_tables(venue_properties=given))
    return view.select("venue_id", "type", F.col("`company.kind`").alias("company_kind"), F.col("`household.size`").alias("household_size"))


def _typed_legs(w: World) -> DataFrame:
    return transit.rider_legs(w, transit.line_venues(w), inspect.home_units(w["population"]), typed=True).select("person_id", "leg_idx", "line_id", "t_board_min", "t_alight_min", "value")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    price = F.when(key % 5 == 0, None).when(key % 5 == 1, F.floor("o_totalprice")).otherwise(F.col("o_totalprice")).cast("double")
    word = F.when(key % 3 == 0, "").when(key % 3 == 1, None).otherwise(F.col("o_orderpriority"))
    list_of = F.when(key % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(key % 7, F.nullif(key % 2, F.lit(0)).cast("long")))
    given = F.when(key % 6 == 0, None).when(key % 6 == 1, "NaN").when(key % 6 == 2, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", cell_number(price).alias("price"), cell_text(word).alias("word"), cell_list(list_of).alias("items"), number(given).alias("number"), identifier(given).alias("id"))


def _journeys(w: World) -> DataFrame:
    """Legs that name the units of journeys, some of them unknown, and some where one is left where it was boarded."""
    person, event = F.col("person_id"), F.col("row_pos")
    board = 100 + event % 25
    fields = {
        transit.ORIGIN: (1000 + person % 25 * 10 + event % 5).cast("double"), transit.BOARD: F.when(event % 7 == 0, -1).otherwise(board).cast("double"),
        transit.ALIGHT: F.when(event % 11 == 0, float("nan")).when(event % 5 == 0, board).otherwise(100 + (event + 1) % 25).cast("double"),
        transit.DESTINATION: F.when(event % 3 != 0, 1000 + (person + event) % 25 * 10).cast("double"),
    }
    named = w.with_tables(legs=w["legs"].withColumns(fields))
    lines = transit.line_venues(named)
    return transit.journey_steps(transit.rider_legs(named, lines, inspect.home_units(named["population"])), lines)


def _journey_stops(w: World) -> DataFrame:
    return _journeys(w).select("person_id", "step", "unit")


def _journey_stop_points(w: World) -> DataFrame:
    units = _journeys(w).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("step", "unit"))).alias("s")).select("person_id", F.transform("s", lambda s: s["unit"]).alias("units"))
    return transit.journey_points(units, w["geo_units"]).select("person_id", "step", "geo_id", "name", "role")


def _square(x, y, side, turned) -> F.Column:
    """A ring of a square from its lower left corner, against the clock, or with it."""
    corners = [F.array(x, y), F.array(x + side, y), F.array(x + side, y + side), F.array(x, y + side)]
    return F.when(turned, F.array(*reversed(corners), corners[3])).otherwise(F.array(*corners, corners[0]))


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as two parts, the first often with a hole, and each supplier as one more feature of its nation; rings turn either way."""
    read = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("k", F.col(key).cast("long"))
    nation, supplier, k = read("nation", "n_nationkey"), read("supplier", "s_suppkey"), F.col("k")
    d = lambda c: c.cast("double")
    shell, hole, other = _square(d(3 * k), d(F.lit(0)), d(2 + k % 3), k % 2 == 0), _square(d(3 * k) + 0.25, d(F.lit(0.5)), d(F.lit(1)), k % 8 < 4), _square(d(3 * k) + 10, d(F.lit(20)), d(F.lit(3)), k % 5 < 2)
    first = F.when(k % 4 != 3, F.array(shell, hole)).otherwise(F.array(shell))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(first, F.array(other)).alias("coordinates")))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(_square(d(k % 100), 50 + d(F.floor(k / 100)) * 2, d(F.lit(1.5)), k % 3 == 0)).alias("coordinates")))
    features = nation.select(F.col("n_name").alias("name"), many.alias("geometry"))
    names = nation.select(F.col("k").alias("n"), F.col("n_name").alias("name"))
    features = features.unionByName(supplier.join(F.broadcast(names), F.col("s_nationkey") == F.col("n")).select("name", one.alias("geometry")))  # nations of the world
    shapes = features.select(F.create_map(F.lit("NAME"), "name").alias("props"), "geometry")
    return match.boundary_extents(match.matched_features(star_world(spark, sf_dir)["geo_units"], shapes, 1, "NAME", "name"))


def _untyped_replicas(w: World) -> DataFrame:
    untyped = w["venues"].withColumn("type_code", F.when(F.col("venue_id") % 3 != 0, F.col("type_code")))
    return _replicas(w.with_tables(venues=untyped))["venues"].select("venue_id", "geo_unit_id", "type_code", "rank_in_type")


def _directory(w: World) -> DataFrame:
    return tiles.tile_directory(_pyramid_tiles(w))


def _view_maximum(w: World) -> DataFrame:
    """The largest counts in windows around the places of nations, from small ones to such as span many tiles, at the zoom of resolution 7."""
    k, lat, lon = F.col("geo_id"), F.col("lat").cast("double"), F.col("lon").cast("double")
    half = 0.05 + 0.45 * (k % 5)
    boxes = w["geo_units"].filter("level = 1").select(k.alias("view"), (lon - half).alias("minx"), (lat - half).alias("miny"), (lon + half).alias("maxx"), (lat + half).alias("maxy"))
    return tiles.view_maximum(_pyramid_tiles(w), tiles.views(boxes, 10))


def _hashed_offsets(w: World) -> DataFrame:
    """Offsets of people in the order of hashed ids, by sex: keys as sparse as they can be."""
    key = F.conv(F.substring(F.md5(F.col("person_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    counts = w["population"].select(key.alias("key"), (F.col("person_id") % 9).alias("n"), "sex_code")
    return inspect.csr_offsets(counts, "key", "n", "sex_code")


def _people_of_orders(w: World, orders: DataFrame) -> DataFrame:
    """People by the ids that orders name, and ids that nobody has."""
    ids = orders.select(F.col("o_custkey").cast("long").alias("person_id"))
    return inspect.people_by_ids(w, ids.unionByName(ids.select((-F.col("person_id") - 1).alias("person_id"))))


def _riders_of_nations(w: World) -> DataFrame:
    """People who ride all lines of a nation."""
    lines = transit.line_venues(w)
    riders = transit.riders(w, lines, inspect.home_units(w["population"]))
    return transit.riders_of_sets(riders, lines.select(F.col("geo_unit_id").alias("set"), "venue_id"))


def wide_levels(w: World) -> DataFrame:
    """The wide panel of every level with all its columns; the people are looked at once."""
    closure, properties = cut(geo.geo_closure(w["geo_units"])), panel.categorical_properties(w)
    long, people = cut(panel.panel_long(w, closure, properties=properties)), cut(panel.panel_people(w, closure))
    names, out = panel.panel_names(w, properties, long), None
    for level in sorted(w.labels_of("geo_levels")):  # a few
        at = F.col("level") == level
        wide = panel.widened(long.filter(at).drop("level"), people.filter(at), names).withColumn("level", F.lit(level))
        out = wide if out is None else out.unionByName(wide)
    return out


def _on_star(query):
    return lambda spark, sf_dir: query(star_world(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet"))


WORLD_QUERIES = {
    "journey_stops": _journey_stops,
    "journey_stop_points": _journey_stop_points,
    "replicate_untyped": _untyped_replicas,
    "tile_directory": _directory,
    "view_maximum": _view_maximum,
    "csr_offsets_hashed": _hashed_offsets,
    "riders_of_sets": _riders_of_nations,
    "panel_wide_levels": wide_levels,
    "tile_rings": _rings,
    "tile_corners": _corners,
    "tile_bounds": _bounds,
    "replicate_unit_places": lambda w: _places(w, "geo_units", "geo_id"),
    "replicate_venue_places": lambda w: _places(w, "venues", "venue_id"),
    "replicate_activities": lambda w: _replicas(w)["activities"].select("person_id", "geo_unit_id", "activity_idx", "venue_id"),
    "replicate_members": lambda w: members_of(_replicas(w)["subsets"]).select("venue_id", "geo_unit_id", "subset_index", "person_id"),
    "replicate_relations": _friends,
    "csr_slices": _slices,
    "relabel_lists": _labels,
    "venue_properties": _venue_properties,
    "rider_legs_typed": _typed_legs,
    "units_rows": lambda w: units_rows(w["population"], list(range(1000, 1250, 3))).select("person_id", "geo_unit_id"),
}
ODD_QUERIES = {
    "odd_people_view": lambda w: inspect.people_view(w).select("person_id", F.nanvl("age", F.lit(-999.0)).cast("double").alias("age"), "sex", "mktsegment"),
    "odd_panel_people": _odd_people,
    "odd_panel_counts": lambda w: _odd_long(w, "sex", "p"),
    "odd_panel_venues": lambda w: _odd_long(w, "venues", "occ"),
    "odd_members_view": lambda w: inspect.members_view(w, inspect.home_units(w["population"])).select("venue_id", "subset_index", "subset", "person_id", "home_geo_unit"),
    "odd_activities_view": lambda w: inspect.activities_view(w).drop("geo_unit_id"),
    "odd_line_geometry": _odd_geometry,
}
TABLE_QUERIES = {"cell_texts": _cells, "boundary_centroids": _centroids, "people_of_orders": _on_star(_people_of_orders)}

"""Transit lines, their riders, and journeys of several legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mercator import world_x, world_y
from ..sources.world import BASE, World
from .inspect import with_home
from .profile import whole_fields

#: Venue types that are lines; the mode is the type without ``_line``.
LINE_TYPES = ("train_line", "tube_line")
#: Fields of legs that name the units of a journey: before the first leg, of each leg, after the last.
ORIGIN, BOARD, ALIGHT, DESTINATION = "origin_unit_id", "board_unit_id", "alight_unit_id", "dest_unit_id"


def line_venues(world: World, types: tuple[str, ...] = LINE_TYPES) -> DataFrame:
    """venue_id, line_id (its name), mode, geo_unit_id."""
    codes = world.registry("venue_types").filter(F.col("label").isin(*types)).select(F.col("code").alias("type_code"), "label")
    rows = world["venues"].join(F.broadcast(codes), "type_code")  # as many rows as line types
    return rows.select("venue_id", F.coalesce("name", F.col("venue_id").cast("string")).alias("line_id"), F.replace(F.col("label"), F.lit("_line"), F.lit("")).alias("mode"), "geo_unit_id", "row_pos")


def riders(world: World, lines: DataFrame, homes: DataFrame | None) -> DataFrame:
    """venue_id, person_id, home_geo_unit: members of line venues in the venue's own unit, repeats and all."""
    on_line = world["members"].select("venue_id", "geo_unit_id", "person_id").join(lines.select("venue_id", "geo_unit_id"), ["venue_id", "geo_unit_id"])
    return with_home(on_line.select("venue_id", "person_id"), homes)


def rider_counts(lines: DataFrame, riders: DataFrame) -> DataFrame:
    counts = riders.groupBy("venue_id").agg(F.count("*").alias("rider_count"))
    return lines.join(counts, "venue_id", "left").select("venue_id", "line_id", "mode", "geo_unit_id", "row_pos", F.coalesce("rider_count", F.lit(0)).alias("rider_count"))


def line_geometry(line_stops: DataFrame, coord_mgu: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """line_id and stops (position, node, name, lon, lat) in order; only lines with two or more placed stops.

    Of a node's coordinates the last row counts; ``lines`` restricts the catalogue.
    """
    coords = coord_mgu.groupBy(F.col("MGU").alias("node_mgu")).agg(F.max_by(F.struct("longitude", "latitude"), "row_pos").alias("c"))
    stops = line_stops if lines is None else line_stops.join(lines.select("line_id").distinct(), "line_id", "left_semi")
    placed = stops.join(coords, "node_mgu")
    listed = placed.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("node_mgu").alias("node"), "name", F.col("c.longitude").alias("lon"), F.col("c.latitude").alias("lat")))).alias("stops"))
    return listed.filter(F.size("stops") >= 2)


def placed_lines(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """The first venue of each line that has a geometry, with its stops."""
    first = lines.groupBy("line_id").agg(F.min_by(F.struct("venue_id", "mode"), F.struct("row_pos", "venue_id")).alias("v"))
    return first.join(geometry, "line_id").select("line_id", "v.venue_id", "v.mode", "stops")


def lines_in_world(counted: DataFrame, geometry: DataFrame) -> DataFrame:
    """The first venue of each line that has a geometry, with its riders and stops."""
    first = counted.groupBy("line_id").agg(F.min_by(F.struct("venue_id", "mode", "rider_count"), F.struct("row_pos", "venue_id")).alias("v"))
    return first.join(geometry, "line_id").select("line_id", "v.venue_id", "v.mode", "v.rider_count", "stops")


def top_lines(counted: DataFrame, n: int = 3) -> DataFrame:
    """The lines with the most riders, ties in venue order."""
    return counted.orderBy(F.desc("rider_count"), "row_pos").limit(n).select("venue_id", "line_id", "mode", "rider_count")


def leg_fields(legs: DataFrame) -> list[str]:
    """Declared fields that pass through; names of the result's own columns do not."""
    own = {*BASE["legs"], "line_id", "mode", "home_geo_unit"}
    return [c for c in legs.columns if c not in own]


def rider_legs(world: World, lines: DataFrame, homes: DataFrame | None, typed: bool = False) -> DataFrame:
    """Each rider's legs on lines, numbered from 0 by recorded number, else by boarding time, else as in the file.

    ``typed`` turns fields of whole numbers into integers, which takes a pass over the legs.
    """
    legs = world["legs"].join(lines.select("venue_id", "line_id", "mode"), "venue_id")
    key = next((c for c in ("leg_idx", "t_board_min") if c in legs.columns), "row_pos")
    order = Window.partitionBy("person_id").orderBy(key, "row_pos")
    fields = ["t_board_min"] * ("t_board_min" in legs.columns) + leg_fields(world["legs"])
    rows = legs.select("person_id", (F.row_number().over(order) - 1).alias("leg_idx"), "venue_id", F.coalesce("line_id", F.lit("")).alias("line_id"), F.coalesce("mode", F.lit("")).alias("mode"), *(F.col(f"`{c}`") for c in fields))
    whole = whole_fields(world["legs"], fields) if typed else []
    return with_home(rows.withColumns({c: F.col(f"`{c}`").cast("long") for c in whole}), homes)


def leg_durations(legs: DataFrame) -> DataFrame:
    return legs.withColumn("minutes", F.col("t_alight_min") - F.col("t_board_min"))


def shared_riders(riders: DataFrame, venues: list[int]) -> DataFrame:
    """People who ride every one of the venues; with one venue each membership is a row."""
    on = riders.filter(F.col("venue_id").isin(venues))
    if len(venues) < 2:
        return on.select("person_id")
    return on.groupBy("person_id").agg(F.count_distinct("venue_id").alias("_n")).filter(F.col("_n") == len(set(venues))).select("person_id")


def riders_of_sets(riders: DataFrame, sets: DataFrame) -> DataFrame:
    """set, person_id: people who ride every venue of a set (``set``, ``venue_id``); a venue named twice counts once."""
    sets = sets.select("set", "venue_id").distinct()
    sizes = sets.groupBy("set").agg(F.count("*").alias("_size"))
    ridden = riders.select("venue_id", "person_id").distinct().join(sets, "venue_id").groupBy("set", "person_id").agg(F.count("*").alias("_n"))
    return ridden.join(sizes, "set").filter("_n = _size").select("set", "person_id")


def journey_steps(legs: DataFrame, lines: DataFrame) -> DataFrame:
    """person_id, step (from 0) and unit: the units that a rider passes, in order, without unknown ones and immediate repeats.

    They are the origin of the first leg, where each leg is boarded and left,
    and the destination of the last. A field that no leg has names no units;
    legs with none of the four fields pass home and then the unit of each
    leg's line. Fields may be any numbers: null, NaN and negatives are unknown.
    """
    order = Window.partitionBy("person_id").orderBy("leg_idx")
    if not {ORIGIN, BOARD, ALIGHT, DESTINATION} & set(legs.columns):
        legs = legs.join(lines.select("venue_id", F.col("geo_unit_id").cast("long").alias(BOARD)), "venue_id", "left").withColumn(ORIGIN, F.col("home_geo_unit"))
    here = lambda c: F.col(c).cast("double") if c in legs.columns else F.lit(None).cast("double")
    unit = lambda c: F.when(~F.isnan(here(c)) & (here(c) >= 0), F.col(c).cast("long")) if c in legs.columns else F.lit(None).cast("long")
    first, last = F.lag("leg_idx").over(order).isNull(), F.lead("leg_idx").over(order).isNull()
    ends = legs.select("person_id", "leg_idx", F.when(first, unit(ORIGIN)).alias("_o"), unit(BOARD).alias("_b"), unit(ALIGHT).alias("_a"), F.when(last, unit(DESTINATION)).alias("_d"))
    stops = ends.select("person_id", "leg_idx", F.posexplode(F.array("_o", "_b", "_a", "_d")).alias("_k", "unit")).filter("unit is not null")
    along = Window.partitionBy("person_id").orderBy("leg_idx", "_k")
    moved = stops.withColumn("_before", F.lag("unit").over(along)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("unit")))
    return moved.select("person_id", (F.row_number().over(along) - 1).alias("step"), "unit")


def journey_units(legs: DataFrame, lines: DataFrame) -> DataFrame:
    """person_id and units of :func:`journey_steps` as a list; riders without a known unit have an empty one."""
    listed = journey_steps(legs, lines).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("step", "unit"))).alias("_s"))
    people = legs.select("person_id").distinct().join(listed, "person_id", "left")
    return people.select("person_id", F.coalesce(F.transform("_s", lambda s: s["unit"]), F.array().cast("array<bigint>")).alias("units"))


def journey_points(units: DataFrame, geo_units: DataFrame) -> DataFrame:
    """person_id, step, geo_id, name, role: start, via, end of journeys with two or more placed points."""
    at = units.select("person_id", F.posexplode("units").alias("pos", "geo_id")).join(geo_units.filter("lat is not null and lon is not null").select("geo_id", "name", "lat", "lon"), "geo_id")
    w = Window.partitionBy("person_id")
    rows = at.withColumn("step", F.row_number().over(w.orderBy("pos")) - 1).withColumn("_n", F.count("*").over(w)).filter("_n >= 2")
    role = F.when(F.col("step") == 0, "start").when(F.col("step") == F.col("_n") - 1, "end").otherwise("via")
    return rows.select("person_id", "step", "geo_id", F.coalesce("name", F.concat(F.lit("unit "), "geo_id")).alias("name"), "lat", "lon", role.alias("role"))


def transit_summary(counted: DataFrame, riders: DataFrame, legs: DataFrame) -> DataFrame:
    """lines, train, tube, memberships, riders_with_chains in one row."""
    kinds = counted.agg(F.count("*").alias("lines"), F.count_if(F.col("mode") == "train").alias("train"), F.count_if(F.col("mode") == "tube").alias("tube"))
    return kinds.crossJoin(riders.agg(F.count("*").alias("memberships"))).crossJoin(legs.agg(F.count_distinct("person_id").alias("riders_with_chains")))  # one row each


def lines_geojson(lines: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, by line_id; written as text it is a JSON-lines collection."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("stops", lambda s: F.array(s["lon"], s["lat"])).alias("coordinates"))
    props = F.struct("line_id", "venue_id", "mode", "rider_count", F.transform("stops", lambda s: s["name"]).alias("stops"))
    return lines.select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("feature")).orderBy("line_id")


def sample_riders(counted: DataFrame, riders: DataFrame, legs: DataFrame, n: int = 3) -> DataFrame:
    """For each top line, the first rider with two or more legs."""
    several = legs.groupBy("person_id").agg(F.count("*").alias("legs")).filter("legs >= 2")
    found = top_lines(counted, n).join(riders.select("venue_id", "person_id"), "venue_id").join(several, "person_id")
    return found.groupBy("venue_id", "line_id", "rider_count").agg(F.min(F.struct("person_id", "legs")).alias("p")).select("venue_id", "line_id", "rider_count", "p.person_id", "p.legs")


def stop_points(lines: DataFrame) -> DataFrame:
    """A row for each stop, as :func:`gridfolk.operators.tiles.line_tiles` takes them."""
    return lines.select("line_id", "venue_id", F.explode("stops").alias("s")).select("line_id", "venue_id", F.col("s.position").alias("position"), F.col("s.lon").alias("lon"), F.col("s.lat").alias("lat"))


def segment_lengths(lines: DataFrame) -> DataFrame:
    """line_id and the length of its pieces on the plane of zoom 0, in tile units."""
    stop = Window.partitionBy("line_id").orderBy("position")
    at = stop_points(lines).withColumns({"x": world_x(F.col("lon"), 0), "y": world_y(F.col("lat"), 0)})
    moves = at.withColumns({"dx": F.col("x") - F.lag("x").over(stop), "dy": F.col("y") - F.lag("y").over(stop)})
    return moves.groupBy("line_id").agg(F.count("dx").alias("pieces"), F.sum(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("length"))

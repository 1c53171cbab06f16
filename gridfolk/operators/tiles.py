"""Feature tables of vector tiles, and the index of tiles in Hilbert order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import RESOLUTIONS, by_resolution, centre, ring
from ..functions.mercator import EXTENT, ZOOM_OF, tile_id, tile_lat, tile_lon, world_y
from .prefix import running

#: Zooms at which lines are cut, one by one, so that no zoom between is blank.
LINE_ZOOMS = (5, 12)
#: A view is made of squares of tiles; it is at most about so many squares wide and high.
ACROSS = 16


def hexagon_tiles(pyramid: DataFrame) -> DataFrame:
    """z, x, y, layer, res, q, r, count, ring: each cell in the tile of its centre, its corners in the tile's units."""
    q, r, res = F.col("q"), F.col("r"), F.col("res")
    side = by_resolution(res, lambda k: float(2 ** ZOOM_OF[k]))
    cx, cy = centre(q, r, res)
    rows = pyramid.filter(res.isin(*RESOLUTIONS)).withColumns({"z": by_resolution(res, lambda k: ZOOM_OF[k]), "x": F.floor(cx * side).cast("long"), "y": F.floor(cy * side).cast("long"), "_side": side})
    unit = lambda v, t: F.rint(v * F.col("_side") * EXTENT - F.col(t) * EXTENT).cast("long")
    corners = F.transform(ring(q, r, res), lambda p: F.struct(unit(p["x"], "x").alias("px"), unit(p["y"], "y").alias("py")))
    return rows.select("z", "x", "y", "layer", "res", "q", "r", "count", corners.alias("ring"))


def hexagon_features(tiles: DataFrame) -> DataFrame:
    """A row for each tile and layer with its features; a tile holds as many cells as fit in it."""
    return tiles.groupBy("z", "x", "y", "layer").agg(F.array_sort(F.collect_list(F.struct("q", "r", "count", "ring"))).alias("features"))


def covered(boxes: DataFrame, zoom: Column) -> DataFrame:
    """z, x, y of every tile that a box (minx, miny, maxx, maxy) touches at a zoom, clamped to the world."""
    rows = boxes.withColumn("z", zoom).withColumn("_n", F.pow(F.lit(2.0), F.col("z")).cast("long"))
    across = lambda lon: F.floor((F.col(lon) + 180.0) / 360.0 * F.col("_n"))
    down = lambda lat: F.floor(world_y(F.col(lat), F.col("z")) / EXTENT)
    held = lambda v: F.greatest(F.lit(0), F.least(F.col("_n") - 1, v)).cast("long")
    rows = rows.withColumn("x", F.explode(F.sequence(held(across("minx")), held(across("maxx")))))
    return rows.withColumn("y", F.explode(F.sequence(held(down("maxy")), held(down("miny"))))).drop("_n")


def boundary_tiles(extents: DataFrame, bands: DataFrame) -> DataFrame:
    """The tiles that each unit's box touches at its level's zoom (level, geo_id, z, x, y)."""
    joined = extents.join(F.broadcast(bands.select("level", "bake_zoom")), "level")  # a few levels
    return covered(joined, F.col("bake_zoom")).select("level", "geo_id", "z", "x", "y")


def line_tiles(lines: DataFrame, zooms: tuple[int, int] = LINE_ZOOMS) -> DataFrame:
    """line_id, venue_id, z, x, y, part, points: lines cut at the tiles they cross at every zoom.

    ``lines`` has a row for each stop (line_id, venue_id, position, lon, lat).
    Each piece from stop to stop is dealt to the columns of tiles that it
    crosses, and in each column to the rows that it crosses there, so tiles
    grow with its length. Its parameters at the tile's four sides bound the
    part inside; neighbouring pieces of one tile are joined to parts again,
    points in the tile's units.
    """
    stop = Window.partitionBy("line_id").orderBy("position")
    pairs = lines.select("line_id", "venue_id", F.row_number().over(stop).alias("n"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.lead("lon").over(stop).alias("x1"), F.lead("lat").over(stop).alias("y1")).filter("x1 is not null")
    n = F.pow(F.lit(2.0), F.col("z"))
    each = pairs.withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    across, down = (lambda c: (F.col(c) + 180.0) / 360.0 * n), (lambda c: world_y(F.col(c), F.col("z")) / EXTENT)
    each = each.withColumns({"_ax": across("x0"), "_bx": across("x1"), "_ay": down("y0"), "_by": down("y1")})
    held = lambda v: F.greatest(F.lit(0), F.least(n - 1, F.floor(v))).cast("long")
    cut = each.withColumn("x", F.explode(F.sequence(held(F.least("_ax", "_bx")), held(F.greatest("_ax", "_bx")))))
    # Where the piece is at the column's two sides, within its ends; a little more, as rows it misses are cut off below.
    width = F.nullif(F.col("_bx") - F.col("_ax"), F.lit(0.0))
    at_side = lambda side: F.col("_ay") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (side - F.col("_ax")) / width)) * (F.col("_by") - F.col("_ay"))
    here, there = F.coalesce(at_side(F.col("x")), F.col("_ay")), F.coalesce(at_side(F.col("x") + 1), F.col("_by"))
    cut = cut.withColumn("y", F.explode(F.sequence(held(F.least(here, there) - 1e-6), held(F.greatest(here, there) + 1e-6)))).drop("_ax", "_bx", "_ay", "_by")
    px = lambda lon: (F.col(lon) + 180.0) / 360.0 * n * EXTENT - F.col("x") * EXTENT
    py = lambda lat: world_y(F.col(lat), F.col("z")) - F.col("y") * EXTENT
    cut = cut.withColumns({"ax": px("x0"), "ay": py("y0"), "bx": px("x1"), "by": py("y1")}).withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")})

    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for delta, low in (("dx", "ax"), ("dy", "ay")):
        to_zero, to_end = -F.col(low), EXTENT - F.col(low)
        still = F.col(delta) == 0
        outside = still & ((F.col(low) < 0) | (F.col(low) > EXTENT))
        a, b = to_zero / F.nullif(F.col(delta), F.lit(0.0)), to_end / F.nullif(F.col(delta), F.lit(0.0))
        enter.append(F.when(outside, 2.0).when(still, 0.0).otherwise(F.least(a, b)))
        leave.append(F.when(outside, -1.0).when(still, 1.0).otherwise(F.greatest(a, b)))
    cut = cut.withColumn("t0", F.greatest(*enter)).withColumn("t1", F.least(*leave)).filter("t0 < t1")
    at = lambda t: F.struct(F.rint(F.col("ax") + F.col(t) * F.col("dx")).cast("long").alias("px"), F.rint(F.col("ay") + F.col(t) * F.col("dy")).cast("long").alias("py"))
    in_tile = Window.partitionBy("line_id", "z", "x", "y").orderBy("n")
    joined = (F.lag("n").over(in_tile) == F.col("n") - 1) & (F.lag("t1").over(in_tile) == 1.0) & (F.col("t0") == 0.0)
    cut = cut.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("_new").over(in_tile).cast("int"))
    parts = cut.groupBy("line_id", "venue_id", "z", "x", "y", "part").agg(F.array_sort(F.collect_list(F.struct("n", at("t0").alias("a"), at("t1").alias("b")))).alias("_s"))
    return parts.select("line_id", "venue_id", "z", "x", "y", "part", F.concat(F.array(F.get("_s", 0)["a"]), F.transform("_s", lambda s: s["b"])).alias("points"))


def tile_index(tiles: DataFrame) -> DataFrame:
    """tile_id, z, x, y, n_features of every tile."""
    counts = tiles.groupBy("z", "x", "y").agg(F.count("*").alias("n_features"))
    return counts.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "z", "x", "y", "n_features")


def tile_directory(tiles: DataFrame) -> DataFrame:
    """tile_id, z, x, y, offset and length: where each tile's features begin in a table in the order of tile ids, and how many they are."""
    placed = running(tile_index(tiles), "n_features", ["tile_id"])
    return placed.select("tile_id", "z", "x", "y", "offset", F.col("n_features").alias("length"))


def with_tile_id(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_id", tile_id(F.col("z"), F.col("x"), F.col("y")))


def views(boxes: DataFrame, zoom: int) -> DataFrame:
    """Boxes (view, minx, miny, maxx, maxy) as windows of tiles at a zoom: view, z, x0, y0, x1, y1, clamped to the world."""
    n = 1 << zoom
    across = lambda lon: F.floor((F.col(lon) + 180.0) / 360.0 * n)
    down = lambda lat: F.floor(world_y(F.col(lat), zoom) / EXTENT)
    held = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    return boxes.select("view", F.lit(zoom).alias("z"), held(across("minx")).alias("x0"), held(down("maxy")).alias("y0"), held(across("maxx")).alias("x1"), held(down("miny")).alias("y1"))


def view_squares(windows: DataFrame) -> DataFrame:
    """Each view's squares of tiles: ``depth``, ``sx``, ``sy``, and ``first`` and ``last`` tile id, which holds because a square of the curve is one stretch of it.

    The side of the squares is a power of two that grows with the view, so a
    view has few of them; those at its edge hold tiles outside it, too.
    """
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    less = F.greatest(F.lit(0), F.least(F.col("z"), F.ceil(F.log2(wide / ACROSS)).cast("int")))
    rows = windows.withColumn("_less", less).withColumn("depth", F.col("z") - F.col("_less"))
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_less"))
    rows = rows.withColumn("sx", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))))
    rows = rows.withColumn("sy", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor(F.col("y1") / side))))
    before = lambda z: ((F.pow(F.lit(4.0), z).cast("long") - 1) / 3).cast("long")  # noqa: E731  tiles of all smaller zooms
    place = tile_id(F.col("depth"), F.col("sx"), F.col("sy")) - before(F.col("depth"))
    first = before(F.col("z")) + place * side * side
    return rows.withColumn("first", first).withColumn("last", F.col("first") + side * side - 1).drop("_less")


def view_ranges(squares: DataFrame) -> DataFrame:
    """view, first, last: the stretches of tile ids that a view's squares make together."""
    along = Window.partitionBy("view").orderBy("first")
    fresh = F.coalesce(F.col("first") > F.lag("last").over(along) + 1, F.lit(True)).cast("int")
    runs = squares.select("view", "first", "last").withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(along))
    return runs.groupBy("view", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def in_view(tiles: DataFrame, window: DataFrame) -> DataFrame:
    """The rows (z, x, y, tile_id) of one view: on a clustered table, only row groups of its stretches are read."""
    ranges = view_ranges(view_squares(window)).select("first", "last").collect()  # few, as squares are few
    at = window.first()
    near = F.lit(False)
    for first, last in ranges:
        near |= F.col("tile_id").between(first, last)
    return tiles.filter(near).filter((F.col("z") == at["z"]) & F.col("x").between(at["x0"], at["x1"]) & F.col("y").between(at["y0"], at["y1"]))


def view_maximum(tiles: DataFrame, windows: DataFrame) -> DataFrame:
    """view, layer, largest: the largest count that each view shows; views without a cell have no row."""
    squares = view_squares(windows)
    depths = sorted({(x["z"], x["depth"]) for x in squares.select("z", "depth").distinct().collect()})  # not more than zooms squared
    keyed = None
    for z, depth in depths:
        square = lambda c, z=z, depth=depth: F.shiftright(c, z - depth)
        rows = tiles.filter(F.col("z") == z).select("z", "x", "y", "layer", "count", F.lit(depth).alias("depth"), square("x").alias("sx"), square("y").alias("sy"))
        keyed = rows if keyed is None else keyed.unionByName(rows)
    if keyed is None:
        return tiles.select(F.lit(None).cast(windows.schema["view"].dataType).alias("view"), "layer", F.col("count").alias("largest")).limit(0)
    shown = keyed.join(squares.select("view", "z", "depth", "sx", "sy", "x0", "y0", "x1", "y1"), ["z", "depth", "sx", "sy"])
    shown = shown.filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return shown.groupBy("view", "layer").agg(F.max("count").alias("largest"))


def tile_corners(index: DataFrame) -> DataFrame:
    """The index with the tile's sides: west, south, east, north."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    return index.withColumns({"west": tile_lon(x, z), "south": tile_lat(y + 1, z), "east": tile_lon(x + 1, z), "north": tile_lat(y, z)})


def clustered(index: DataFrame, *then: str) -> DataFrame:
    """In the order of tile ids, for writing: neighbours on the map are neighbours in the files, whose ranges of ids don't overlap."""
    return index.repartitionByRange("tile_id").sortWithinPartitions("tile_id", *then)


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.count_distinct("z", "x", "y").alias("tiles"), F.count("*").alias("features"), F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count_distinct("layer").alias("layers"))


def dataset_bounds(points: DataFrame) -> DataFrame:
    """Bounds and centre of points (lat, lon)."""
    box = points.agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    return box.withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2})

"""How well boundary features match the units of each level, and their extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import STRATEGIES
from ..functions.display import match_flag

#: Zooms between which levels are spread, and the zoom up to which the finest is shown.
Z_MIN, Z_MAX, Z_OVER = 3, 12, 22
GEOMETRY = "type string, coordinates string"


def feature_values(features: DataFrame) -> DataFrame:
    """prop, prop_pos, value, row_pos of every feature and property; properties in the order of their names."""
    rows = features.select("row_pos", F.explode("props").alias("prop", "value"))
    names = rows.select("prop").distinct().withColumn("prop_pos", F.dense_rank().over(Window.orderBy("prop")))  # a few names
    return rows.join(F.broadcast(names), "prop")


def _keys(rows: DataFrame, column: str) -> DataFrame:
    """A row for each strategy, with its position and the normalised key."""
    each = F.array(*(F.struct(F.lit(i).alias("strategy_pos"), F.lit(n).alias("strategy"), f(F.col(column)).alias("key")) for i, (n, f) in enumerate(STRATEGIES.items())))
    return rows.select("*", F.inline(each))


def candidates(geo_units: DataFrame, features: DataFrame) -> DataFrame:
    """level, prop, strategy, matched: the units whose key some feature has."""
    known = _keys(feature_values(features), "value").filter("key != ''").select("prop", "prop_pos", "strategy", "key").distinct()
    units = _keys(geo_units.select("level", "geo_id", "name"), "name").filter("key != ''")
    return units.join(known, ["strategy", "key"]).groupBy("level", "prop", "prop_pos", "strategy", "strategy_pos").agg(F.count("*").alias("matched"))


def match_report(geo_units: DataFrame, features: DataFrame, strategy: str | None = None) -> DataFrame:
    """level, world_units, matched, strategy, prop, rate, flag: the best property and strategy (or the one given) of each level, the earliest of equals."""
    best = Window.partitionBy("level").orderBy(F.desc("matched"), "prop_pos", "strategy_pos")
    found = candidates(geo_units, features)
    found = found.filter(F.col("strategy") == strategy) if strategy else found
    top = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("level", "prop", "strategy", "matched")
    units = geo_units.groupBy("level").agg(F.count("*").alias("world_units"))
    rate = F.coalesce("matched", F.lit(0)) / F.col("world_units")
    return units.join(top, "level", "left").select("level", "world_units", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("strategy", F.lit("none")).alias("strategy"), "prop", rate.alias("rate"), match_flag(rate).alias("flag"))


def poorest_rate(report: DataFrame, least: float = 0.5) -> float:
    """The rate of the worst level of a report (a row for each level); raises if it is below ``least``."""
    worst = report.orderBy("rate", "level").select("level", "rate").first()
    if worst and worst["rate"] < least:
        raise ValueError(f"only {worst['rate']:.0%} of level {worst['level']} match; at least {least:.0%} are needed")
    return worst["rate"] if worst else 1.0


def unmatched(geo_units: DataFrame, features: DataFrame, most: int = 8) -> DataFrame:
    """level, side, n, value: the first names without a partner under the level's best match.

    World names come in file order, feature values sorted and distinct, or in
    file order where nothing matched (then of the first property).
    """
    report = match_report(geo_units, features).select("level", "strategy", "prop")
    values = feature_values(features)
    units = _keys(geo_units.select("level", "geo_id", "name", "row_pos"), "name").join(report.filter("prop is not null"), ["level", "strategy"])
    keyed = _keys(values, "value")
    world = units.join(keyed.filter("key != ''").select("prop", "strategy", "key").distinct(), ["prop", "strategy", "key"], "left_anti").select("level", F.lit("world").alias("side"), F.col("name").alias("value"), "row_pos")
    none = report.filter("prop is null").select("level")
    world = world.unionByName(geo_units.join(none, "level").select("level", F.lit("world").alias("side"), F.col("name").alias("value"), "row_pos"))
    chosen = keyed.join(report.filter("prop is not null"), ["prop", "strategy"])
    feature = chosen.join(units.select("level", "key").distinct(), ["level", "key"], "left_anti").select("level", "value").distinct().withColumn("row_pos", F.lit(0).cast("long"))
    plain = values.filter("prop_pos = 1").select("value", "row_pos").crossJoin(F.broadcast(none)).select("level", "value", "row_pos")  # a few levels
    feature = feature.unionByName(plain).select("level", F.lit("feature").alias("side"), "value", "row_pos")
    order = Window.partitionBy("level", "side").orderBy("row_pos", "value")
    return world.unionByName(feature).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("level", "side", "n", "value")


def unit_keys(geo_units: DataFrame, level: int, strategy: str) -> DataFrame:
    """geo_id and key of a level, the first unit of each key, with how many units share it (``shared``)."""
    rows = geo_units.filter(F.col("level") == level).withColumn("key", STRATEGIES[strategy](F.col("name"))).filter("key != ''")
    return rows.groupBy("key").agg(F.min_by("geo_id", "row_pos").alias("geo_id"), F.count("*").alias("shared"))


def collisions(geo_units: DataFrame, strategy: str) -> DataFrame:
    """level and the units beyond the first of each key."""
    rows = geo_units.withColumn("key", STRATEGIES[strategy](F.col("name"))).filter("key != ''")
    return rows.groupBy("level").agg((F.count("*") - F.count_distinct("key")).alias("collisions"))


def matched_features(geo_units: DataFrame, features: DataFrame, level: int, prop: str, strategy: str) -> DataFrame:
    """geo_id and geometry text; features without a unit are gone before any geometry is parsed."""
    keys = unit_keys(geo_units, level, strategy).select("key", "geo_id")
    return features.withColumn("key", STRATEGIES[strategy](F.try_element_at("props", F.lit(prop)))).join(keys, "key").select("geo_id", "geometry")


def rings(shapes: DataFrame) -> DataFrame:
    """geo_id, part (polygon of the geometry), ring (of the polygon, 0 its shell) and points of polygons and multipolygons; other and broken geometry is skipped."""
    parsed = shapes.withColumn("_g", F.from_json("geometry", GEOMETRY))
    polygon = F.array(F.from_json("_g.coordinates", "array<array<array<double>>>"))
    many = F.from_json("_g.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("_g.type") == "Polygon", polygon).when(F.col("_g.type") == "MultiPolygon", many)
    each = parsed.select("geo_id", F.posexplode(parts).alias("part", "_rings"))
    return each.select("geo_id", "part", F.posexplode("_rings").alias("ring", "points")).filter(F.size("points") >= 3)


def boundary_extents(shapes: DataFrame) -> DataFrame:
    """geo_id, cx, cy, minx, miny, maxx, maxy, rounded to six places.

    The first ring of a polygon adds its area and every later one, a hole,
    takes its area away, whichever way they turn. The box is that of all
    shells; the centroid is exact where parts and features don't overlap.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    cross = lambda p: F.get(p["a"], 0) * F.get(p["b"], 1) - F.get(p["b"], 0) * F.get(p["a"], 1)
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    xs, ys = F.transform("points", lambda p: F.get(p, 0)), F.transform("points", lambda p: F.get(p, 1))
    each = rings(shapes).select(
        "geo_id", "ring", total(cross).alias("a"), total(lambda p: cross(p) * (F.get(p["a"], 0) + F.get(p["b"], 0))).alias("x"), total(lambda p: cross(p) * (F.get(p["a"], 1) + F.get(p["b"], 1))).alias("y"),
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )
    # The sign of the area says how a ring turns; its place says whether it adds or takes away.
    role = F.signum("a") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    shell = lambda c: F.when(F.col("ring") == 0, F.col(c))
    each = each.select("geo_id", *((role * F.col(c)).alias(c) for c in ("a", "x", "y")), *(shell(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")))
    sums = each.groupBy("geo_id").agg(F.sum("a").alias("a"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    middle = lambda v, lo, hi: F.when(F.col("a") != 0, F.col(v) / (3 * F.col("a"))).otherwise((F.col(lo) + F.col(hi)) / 2)
    out = {"cx": middle("x", "minx", "maxx"), "cy": middle("y", "miny", "maxy"), **{c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}}
    return sums.select("geo_id", *(F.round(v, 6).alias(k) for k, v in out.items()))


def attach_extents(panel: DataFrame, extents: DataFrame) -> DataFrame:
    """The panel with its units' extents; null where a unit has no shape."""
    return panel.join(extents, "geo_id", "left")


def zoom_bands(geo_units: DataFrame) -> DataFrame:
    """level, bake_zoom, min_zoom, max_zoom: levels spread over the zooms coarse to fine, each shown until the next begins."""
    levels = geo_units.select("level").distinct()
    order = Window.orderBy("level")  # a few levels
    rows = levels.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    bake = F.when(F.col("n") <= 1, Z_MIN).otherwise(F.rint(Z_MIN + (Z_MAX - Z_MIN) * F.col("r") / F.greatest(F.lit(1), F.col("n") - 1))).cast("int")
    rows = rows.withColumn("bake_zoom", bake).withColumn("_next", F.lead("bake_zoom").over(order))
    top = F.when(F.col("_next").isNull(), Z_OVER).otherwise(F.greatest("bake_zoom", F.col("_next") - 1)).cast("int")
    return rows.select("level", "bake_zoom", F.when(F.col("r") == 0, 0).otherwise(F.col("bake_zoom")).cast("int").alias("min_zoom"), top.alias("max_zoom")).orderBy("level")

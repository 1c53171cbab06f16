"""Queries over tables and texts that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import registry_map
from ..operators import geo, inspect, match, panel, publish, shards, transit
from ..operators.prefix import shared_folder
from ..sources.files import COORDINATES, LINE_STOPS, read_csv, read_features
from ..sources.world import World
from .details_sql import DETAIL_ORACLES
from .star_sql import _LONG, ORACLES, q


def fresh(spark: SparkSession) -> str:
    """A folder that nothing has used."""
    return f"{shared_folder(spark)}/gridfolk-{uuid.uuid4().hex}"


def _shard(view):
    """Write a view by unit with the columns that order a unit's rows, and read the rows of all units of the world from their files."""

    def query(w: World, name: str) -> DataFrame:
        spark, path = w["geo_units"].sparkSession, fresh(w["geo_units"].sparkSession)
        shards.write_shard(view(w), path, within=publish.WITHIN[name], ids=publish.LOOKED_UP[name])
        return shards.read_shard(spark, path, w["geo_units"].select("geo_id"))

    return query


def _homes(w: World) -> DataFrame:
    return inspect.home_units(w["population"])


_VIEWS = {"population": inspect.people_view, "venues": inspect.venues_view, "subsets": lambda w: inspect.members_view(w, _homes(w)), "activities": inspect.activities_view}


def _venues(w: World) -> DataFrame:
    return _shard(inspect.venues_view)(w, "venues").select("venue_id", "geo_unit_id", "type", "name")


def _rows(w: World) -> DataFrame:
    """container, key, rows: what the shards' indexes know of every unit."""
    spark, out = w["geo_units"].sparkSession, None
    for name, view in _VIEWS.items():
        path = fresh(spark)
        shards.write_shard(view(w), path, within=publish.WITHIN[name])
        part = shards.shard_index(spark, path).groupBy("key").agg(F.sum("rows").alias("rows")).select(F.lit(name).alias("container"), "key", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def _riders(w: World) -> DataFrame:
    """Riders by line venue, read for all venues."""
    spark, path, lines = w["venues"].sparkSession, fresh(w["venues"].sparkSession), transit.line_venues(w)
    shards.write_shard(transit.riders(w, lines, _homes(w)), path, "venue_id", ("person_id",))
    return shards.read_shard(spark, path, w["venues"].select("venue_id"), "venue_id").select("venue_id", "person_id", "home_geo_unit")


def _chains(w: World) -> DataFrame:
    """Chains of legs by home unit, read for all units."""
    spark, path = w["venues"].sparkSession, fresh(w["venues"].sparkSession)
    shards.write_shard(transit.rider_legs(w, transit.line_venues(w), _homes(w)), path, "home_geo_unit", ("person_id", "leg_idx"))
    return shards.read_shard(spark, path, w["geo_units"].select("geo_id"), "home_geo_unit")


def _panel(w: World) -> DataFrame:
    spark, path = w["geo_units"].sparkSession, fresh(w["geo_units"].sparkSession)
    publish.write_panels(w, geo.geo_closure(w["geo_units"]), path, None)
    return spark.read.parquet(f"{path}/panel").select("level", "geo_id", "family", "key", "value")


def _people_panel(w: World) -> DataFrame:
    """The wide tables of all levels, of which a reader takes two columns."""
    spark, path = w["geo_units"].sparkSession, fresh(w["geo_units"].sparkSession)
    publish.write_panels(w, geo.geo_closure(w["geo_units"]), path, None)
    return spark.read.parquet(f"{path}/panel_wide").select("level", "geo_id", "people", F.col("`sex:female`").alias("women"))


def _stops(w: World) -> DataFrame:
    """Lines' geometry from stops and coordinates that are written as CSV."""
    spark, path = w["line_stops"].sparkSession, fresh(w["line_stops"].sparkSession)
    for name in ("line_stops", "coord_mgu"):
        w[name].drop("row_pos").write.csv(f"{path}/{name}", header=True)
    lines = transit.line_geometry(read_csv(spark, f"{path}/line_stops", LINE_STOPS), read_csv(spark, f"{path}/coord_mgu", COORDINATES))
    return lines.select("line_id", F.inline("stops")).select("line_id", "position", "node", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _written_features(w: World) -> DataFrame:
    """The boundary features as GeoJSON, a feature a line, read again."""
    spark, path = w["features"].sparkSession, fresh(w["features"].sparkSession) + ".geojsonl"
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("props"), F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))
    w["features"].select(text.alias("value")).write.text(path)
    return read_features(spark, path)


def _features(w: World) -> DataFrame:
    return _written_features(w).select(F.col("props.CODE").alias("code"), F.col("props.LABEL").alias("label"), F.get_json_object("geometry", "$.type").alias("kind"), F.col("crs").isNull().alias("lonlat"))


def _extents(w: World) -> DataFrame:
    return match.boundary_extents(match.matched_features(w["geo_units"], _written_features(w), 1, "LABEL", "name"))


def _line_features(w: World) -> DataFrame:
    """Lines as a text of a GeoJSON feature a line, read again."""
    spark, path, lines = w["venues"].sparkSession, fresh(w["venues"].sparkSession), transit.line_venues(w)
    counted = transit.rider_counts(lines, transit.riders(w, lines, _homes(w)))
    transit.lines_geojson(transit.lines_in_world(counted, transit.line_geometry(w["line_stops"], w["coord_mgu"], lines))).select("feature").write.text(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.properties.line_id").alias("line_id"), F.col("value").alias("feature"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in a text of ``key:code`` pairs, some without a code, to its codes and labels."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pair = F.concat(F.col("n_name"), F.lit(":"), F.when(F.col("n_nationkey") % 6 == 5, " ").otherwise(F.col("n_nationkey").cast("string")))
    text = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("text"))
    return text.select(F.explode(registry_map(F.col("text"))).alias("code", "label"))


def _named(view: str):
    return lambda w: _shard(_VIEWS[view])(w, view)


TABLE_WORLD_QUERIES = {
    "shard_people": _named("population"), "shard_venues": _venues, "shard_members": _named("subsets"), "shard_activities": _named("activities"),
    "shard_rows": _rows, "shard_riders": _riders, "shard_chains": _chains, "panel_table": _panel, "panel_wide_table": _people_panel,
    "csv_stops": _stops, "geojson_features": _features, "geojson_extents": _extents, "line_features": _line_features,
}
TABLE_FILE_QUERIES = {"registry_codes": _registry}


_COUNT = "select '{0}' as container, geo_unit_id as key, count(*) as rows from {1} group by geo_unit_id"
TABLE_ORACLES = {
    "shard_people": ORACLES["people_view"], "shard_venues": f"select venue_id, geo_unit_id, type, name from ({ORACLES['venues_view']})", "shard_members": ORACLES["members_view"], "shard_activities": ORACLES["activities_view"],
    "shard_rows": q(" union all ".join(_COUNT.format(a, b) for a, b in (("population", "population"), ("venues", "venues"), ("subsets", "members"), ("activities", "activities")))),
    "shard_riders": q("select venue_id, person_id, home_geo_unit from riders"), "shard_chains": f"select * from ({ORACLES['rider_legs']}) where home_geo_unit >= 0",
    "panel_table": q("select level, geo_id, family, key, value from long", _LONG),
    "panel_wide_table": q("select l.level, l.geo_id, coalesce(any_value(n), 0) as people, coalesce(sum(value) filter (where family = 'sex' and key = 'female'), 0)::bigint as women from long l left join (select c.level, c.ancestor_id as geo_id, count(*) as n from population p join closure c on c.geo_id = p.geo_unit_id group by all) p on p.level = l.level and p.geo_id = l.geo_id group by l.level, l.geo_id", _LONG),
    "csv_stops": q("select line_id, position, node, lon, lat from stops"),
    "geojson_features": "select upper(n_name) as code, replace(n_name, '_', ' ') as label, 'Polygon' as kind, true as lonlat from nation where n_nationkey % 7 <> 6",
    "geojson_extents": q("select * from extents"),
    "line_features": DETAIL_ORACLES["lines_geojson"],
    "registry_codes": "select n_nationkey::integer as code, n_name as label from nation where n_nationkey % 6 <> 5",
}

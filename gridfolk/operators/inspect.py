"""Views of people, venues, members and activities, by unit or by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import json_array
from ..sources.world import BASE, World
from .prefix import running
from .profile import json_array_typings


def _labelled(rows: DataFrame, labels: DataFrame, code: str, out: str) -> DataFrame:
    """Add the registry's label of a code, else the code as text. Registries are short."""
    known = labels.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    return rows.join(F.broadcast(known), F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_label", F.col(code).cast("string"))).drop("_code", "_label")


def json_properties(world: World) -> dict[str, str]:
    """Properties of people that hold JSON arrays, and what their elements are: bigint if all are whole numbers, else string."""
    names = [f.name for f in world["population"].schema if f.name not in BASE["population"] and f.dataType.typeName() == "string"]
    if not names:
        return {}
    typed = json_array_typings(world["population"], names).first().asDict()  # one row
    return {n: "bigint" if typed[n]["all_whole"] else "string" for n in names if typed[n]["n_arrays"]}


def people_view(world: World, arrays: dict[str, str] | None = None) -> DataFrame:
    """People with their label of sex and their properties; those in ``arrays`` (see :func:`json_properties`) as arrays, empty where the text is none."""
    rows = _labelled(world["population"], world.registry("sex"), "sex_code", "sex")
    names = [c for c in world["population"].columns if c not in BASE["population"]]
    properties = [json_array(F.col(f"`{c}`"), arrays[c]).alias(c) if arrays and c in arrays else F.col(f"`{c}`") for c in names]
    return rows.select("person_id", "geo_unit_id", "age", "sex", *properties)


def venues_view(world: World) -> DataFrame:
    """Type labels, name fallback, absent parent as -1, absent coordinates as NaN, and a sparse column for each type's property."""
    rows = _labelled(world["venues"], world.registry("venue_types"), "type_code", "type")
    nan = F.lit(float("nan")).cast("float")
    rows = rows.select(
        "venue_id", "geo_unit_id", "type", F.coalesce("name", F.col("venue_id").cast("string")).alias("name"), F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "is_residence",
        F.coalesce("lat", nan).alias("lat"), F.coalesce("lon", nan).alias("lon"), "rank_in_type",
    )
    if "venue_properties" in world:
        names = sorted(f"{x['type']}.{x['prop']}" for x in world["venue_properties"].select("type", "prop").distinct().collect())  # declared properties
        wide = world["venue_properties"].withColumn("_name", F.concat_ws(".", "type", "prop")).groupBy("type", "rank_in_type").pivot("_name", names).agg(F.first("value"))
        rows = rows.join(wide, ["type", "rank_in_type"], "left")
    return rows.drop("rank_in_type")


def home_units(population: DataFrame) -> DataFrame:
    return population.select("person_id", F.col("geo_unit_id").alias("home_geo_unit"))


def with_home(rows: DataFrame, homes: DataFrame | None) -> DataFrame:
    """Add ``home_geo_unit``; -1 for unknown people, and for all without an index."""
    if homes is None:
        return rows.withColumn("home_geo_unit", F.lit(-1).cast("long"))
    return rows.join(homes, "person_id", "left").withColumn("home_geo_unit", F.coalesce("home_geo_unit", F.lit(-1)))


def members_view(world: World, homes: DataFrame | None) -> DataFrame:
    """Each member with the subset's label (its own name, else the registry's, else the index) and home unit."""
    rows = _labelled(world["members"], world.registry("subset_names"), "subset_index", "_known").withColumn("subset", F.coalesce("subset_name", "_known"))
    return with_home(rows, homes).select("venue_id", "geo_unit_id", "subset_index", "subset", "person_id", "home_geo_unit")


def venue_index(world: World) -> DataFrame:
    """venue_id, venue_geo_unit, venue_type, venue_name; the last row of a repeated id."""
    last = world["venues"].groupBy("venue_id").agg(F.max_by(F.struct("geo_unit_id", "type_code", "name"), "row_pos").alias("v")).select("venue_id", "v.*")
    named = _labelled(last, world.registry("venue_types"), "type_code", "venue_type")
    return named.select("venue_id", F.col("geo_unit_id").alias("venue_geo_unit"), "venue_type", F.coalesce("name", F.col("venue_id").cast("string")).alias("venue_name"))


def activities_view(world: World, rows: DataFrame | None = None) -> DataFrame:
    """Activities with labels and what is known of the venue: -1 and empty texts for unknown ones."""
    rows = _labelled(world["activities"] if rows is None else rows, world.registry("activity_names"), "activity_idx", "activity")
    rows = rows.join(venue_index(world), "venue_id", "left")
    unit = ["geo_unit_id"] if "geo_unit_id" in rows.columns else []
    return rows.select("person_id", *unit, "activity", "venue_id", F.coalesce("venue_geo_unit", F.lit(-1)).alias("venue_geo_unit"), F.coalesce("venue_type", F.lit("")).alias("venue_type"), F.coalesce("venue_name", F.lit("")).alias("venue_name"))


def people_by_ids(world: World, ids: DataFrame) -> DataFrame:
    """Known people among the ids (``person_id``), each once."""
    return people_view(world).join(ids.select("person_id").distinct(), "person_id", "left_semi")


def activities_by_ids(world: World, ids: DataFrame) -> DataFrame:
    rows = world["activities"].join(ids.select("person_id").distinct(), "person_id", "left_semi").drop("geo_unit_id")
    return activities_view(world, rows)


def venue_member_attributes(world: World) -> DataFrame:
    """Members of every venue with the attributes of the people, wherever they live: one join by person."""
    people = people_view(world).withColumnRenamed("geo_unit_id", "home_geo_unit")
    return world["members"].select("venue_id", "subset_index", "person_id").join(people, "person_id", "left")


def unit_presence(table: DataFrame) -> DataFrame:
    """Units that have rows, with how many."""
    return table.groupBy("geo_unit_id").agg(F.count("*").alias("rows"))


def peak_unit_rows(world: World, names: tuple[str, ...] = ("population", "venues", "subsets", "activities")) -> DataFrame:
    """The rows of each table's largest unit; also a report on skew."""
    parts = [unit_presence(world[n]).agg(F.max("rows").alias("peak")).select(F.lit(n).alias("container"), F.coalesce("peak", F.lit(0)).alias("peak")) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def csr_offsets(counts: DataFrame, key: str, count: str, within: str, block: int | None = None) -> DataFrame:
    """Add exclusive ``offset`` and ``block_end`` (where the next begins) from counts in the order of the key, within each group.

    See :func:`gridfolk.operators.prefix.running`: keys may be sparse or of
    any type. ``block`` is about how many rows a task gets (by default Spark
    decides). Null counts add nothing.
    """
    ranges = -(-counts.count() // block) if block else None
    placed = running(counts, count, [key], [within], ranges)
    return placed.withColumn("block_end", F.col("offset") + F.coalesce(F.col(count), F.lit(0)))


def csr_expand(segments: DataFrame, flat: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (offset, n) to one row for each position, with the flat table's value at it (``pos``, ``value``)."""
    rows = segments.filter("n > 0").withColumn("pos", F.explode(F.sequence("offset", F.col("offset") + F.col("n") - 1)))
    return rows.join(flat, [*keys, "pos"])


def csr_slice(flat: Column, offset: Column, n: Column) -> Column:
    """The same where the flat values are an array of the row."""
    return F.when(n > 0, F.slice(flat, offset + 1, n)).otherwise(F.slice(flat, 1, 0))


def page(rows: DataFrame, order: list[str], group: str, number: int, size: int = 80) -> DataFrame:
    """One page (from 0, clamped to those there are) of each group's rows.

    Spark keeps the first rows of each group, up to the page's end, before it
    shuffles them; so no task sorts a whole group.
    """
    number = max(0, number)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).filter(F.col("_n") < (number + 1) * size)
    last = rows.groupBy(F.col(group).alias("_group")).agg(F.floor((F.count("*") - 1) / size).alias("_last"))
    on_page = F.floor(F.col("_n") / size) == F.least(F.lit(number), F.col("_last"))
    return first.join(last, F.col(group).eqNullSafe(F.col("_group"))).filter(on_page).select(*rows.columns)

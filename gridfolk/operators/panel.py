"""Counts of each unit, rolled up to every level: the panel.

Rows attach to their own unit, at any level. Additive counts are made once
for each source unit and then summed over the closure, so facts are scanned
and shuffled once for all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import AGE_BANDS, age_band
from ..sources.world import World
from .profile import categorical_properties


def rollup(leaf: DataFrame, closure: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums by level, ancestor and keys; a unit coarser than a level doesn't count there."""
    return leaf.join(closure, F.col("geo_unit_id") == F.col("geo_id")).groupBy("level", F.col("ancestor_id").alias("geo_id"), *keys).agg(*(F.sum(s).alias(s) for s in sums))


def people_leaf(population: DataFrame) -> DataFrame:
    """People, sum of ages (NaN and null add nothing) and people by band of each unit."""
    band = age_band(F.col("age"))
    counted = [F.count_if(band == label).alias(f"age:{label}") for _, label in AGE_BANDS]
    age = F.sum(F.when(~F.isnan("age"), F.col("age").cast("double")).otherwise(0.0))
    return population.groupBy("geo_unit_id").agg(F.count("*").alias("people"), F.coalesce(age, F.lit(0.0)).alias("age_sum"), *counted)


def mean_age(total: Column, people: Column) -> Column:
    """Rounded half up to two places; null without people."""
    return F.when(people > 0, F.round(total / people, 2))


def panel_people(world: World, closure: DataFrame) -> DataFrame:
    bands = [f"age:{label}" for _, label in AGE_BANDS]
    sums = rollup(people_leaf(world["population"]), closure, [], ["people", "age_sum", *bands])
    return sums.select("level", "geo_id", "people", mean_age(F.col("age_sum"), F.col("people")).alias("mean_age"), *(F.col(f"`{b}`") for b in bands))


def people_counts(world: World, sex: bool, properties: list[str]) -> DataFrame:
    """People by unit, family and key: ``sex`` by registered label, ``p`` by property and value, all from one look at the people.

    Codes of sex without a label are dropped, without a registry all count as
    ``0``; null and blank values count as ``(none)``.
    """
    rows, items = world["population"], []
    if sex:
        labels = world.registry("sex").select(F.col("code").alias("_code"), F.col("label").alias("_label"))
        if labels.take(1):
            rows = rows.join(F.broadcast(labels), F.col("sex_code") == F.col("_code"), "left")  # a row for each sex
        else:
            rows = rows.withColumn("_label", F.lit("0"))
        items.append(("sex", F.col("_label")))
    for p in properties:
        value = F.col(f"`{p}`")
        items.append(("p", F.concat(F.lit(f"{p}="), F.when(F.coalesce(value, F.lit("")) == "", "(none)").otherwise(value))))
    if not items:
        return rows.select("geo_unit_id", F.lit("").alias("family"), F.lit("").alias("key"), F.lit(0).cast("long").alias("value")).limit(0)
    long = rows.select("geo_unit_id", F.inline(F.array(*(F.struct(F.lit(f).alias("family"), k.alias("key")) for f, k in items)))).filter("key is not null")
    return long.groupBy("geo_unit_id", "family", "key").agg(F.count("*").alias("value"))


def venue_counts(world: World) -> DataFrame:
    """Venues by unit and registered type."""
    counts = world["venues"].groupBy("geo_unit_id", F.col("type_code").alias("code")).agg(F.count("*").alias("value"))
    return counts.join(F.broadcast(world.registry("venue_types")), "code").select("geo_unit_id", F.col("label").alias("key"), "value")


def venue_types(world: World) -> DataFrame:
    """venue_id and type label; of a repeated id the last row counts."""
    last = world["venues"].groupBy("venue_id").agg(F.max_by("type_code", "row_pos").alias("code"))
    return last.join(F.broadcast(world.registry("venue_types")), "code").select("venue_id", "label")


def occupancy(world: World) -> DataFrame:
    """Members by the subset's unit and its venue's type; subsets of unknown venues are dropped."""
    counts = world["members"].groupBy("geo_unit_id", "venue_id").agg(F.count("*").alias("value"))
    return counts.join(venue_types(world), "venue_id").groupBy("geo_unit_id", F.col("label").alias("key")).agg(F.sum("value").alias("value"))


FAMILIES = {"venues": venue_counts, "occ": occupancy}


def panel_long(world: World, closure: DataFrame, families: tuple[str, ...] = ("sex", "venues", "occ", "p"), properties: list[str] | None = None) -> DataFrame:
    """level, geo_id, family, key, value for every count that isn't 0. ``properties``: the categorical ones, if they are known."""
    parts = [FAMILIES[f](world).select("geo_unit_id", F.lit(f).alias("family"), "key", "value") for f in families if f in FAMILIES]
    if {"sex", "p"} & set(families):
        named = [] if "p" not in families else categorical_properties(world) if properties is None else properties
        parts.append(people_counts(world, "sex" in families, named))
    leaf = parts[0]
    for part in parts[1:]:
        leaf = leaf.unionByName(part)
    return rollup(leaf, closure, ["family", "key"], ["value"])


def panel_names(world: World, properties: list[str], counted: DataFrame | None = None) -> list[str]:
    """The columns of a wide panel that count something, in order. ``counted``: a long panel that has the properties' values, if there is one."""
    names = [*(f"sex:{v}" for v in world.labels_of("sex").values()), *(f"{f}:{v}" for f in ("venues", "occ") for v in world.labels_of("venue_types").values())]
    values = people_counts(world, False, properties) if counted is None else counted.filter("family = 'p'")
    names += sorted({f"p:{x['key']}" for x in values.select("key").distinct().collect()})  # at most 64 values of each property
    return names


def widened(long: DataFrame, people: DataFrame, names: list[str]) -> DataFrame:
    """One level's long panel and its people as a wide table: geo_id, mean_age, people, bands and ``names``."""
    wide = long.withColumn("_name", F.concat_ws(":", "family", "key")).groupBy("geo_id").pivot("_name", names).agg(F.sum("value"))
    people = people.drop("level")
    joined = wide.withColumnRenamed("geo_id", "_other").join(people, F.col("_other") == F.col("geo_id"), "full")
    counts = [c for c in [*people.columns, *names] if c not in ("geo_id", "mean_age")]
    return joined.select(F.coalesce("geo_id", "_other").alias("geo_id"), "mean_age", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in counts))


def panel_wide(world: World, closure: DataFrame, level: int, properties: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """One level as a wide table with self-describing, sorted column names; units without any source row have no row.

    Give ``properties`` and ``names`` (see :func:`panel_names`) to make several levels from one look at the people.
    """
    properties = categorical_properties(world) if properties is None else properties
    names = panel_names(world, properties) if names is None else names
    at = closure.filter(F.col("level") == level)
    return widened(panel_long(world, at, properties=properties), panel_people(world, at), names)


def panel_groups(wide: DataFrame) -> DataFrame:
    """A wide panel back to geo_id, kind, item, value and occ (for venues); a property's name ends at the first ``=`` that has something before it."""
    columns = [c for c in wide.columns if c.split(":", 1)[0] in ("age", "sex", "venues", "p") and ":" in c]
    rows = []
    for c in columns:
        kind, item = c.split(":", 1)
        group = kind
        if kind == "p":
            cut = item.find("=")
            if cut <= 0:
                continue
            group, item = f"p:{item[:cut]}", item[cut + 1 :]
        occ = F.col(f"`occ:{item}`") if kind == "venues" and f"occ:{item}" in wide.columns else F.lit(None)
        rows.append(F.struct(F.lit(group).alias("kind"), F.lit(item).alias("item"), F.col(f"`{c}`").cast("long").alias("value"), occ.cast("long").alias("occ")))
    return wide.select("geo_id", F.inline(F.array(*rows)))


def venue_rows(groups: DataFrame) -> DataFrame:
    """Venue types that a unit has, or has people in."""
    return groups.filter((F.col("kind") == "venues") & ((F.col("value") > 0) | (F.col("occ") > 0)))


def shares(long: DataFrame, people: DataFrame) -> DataFrame:
    """Each count as a share: sex of people (or of the sum without people), others of their family's sum; denominator 1 for 0."""
    prefix = F.when(F.col("family") == "p", F.regexp_extract("key", "^([^=]+)=", 1)).otherwise("")
    whole = F.sum("value").over(Window.partitionBy("level", "geo_id", "family", "_prefix"))
    rows = long.withColumn("_prefix", prefix).withColumn("_sum", whole).join(people.select("level", "geo_id", "people"), ["level", "geo_id"], "left")
    base = F.when(F.col("family") == "sex", F.coalesce(F.nullif("people", F.lit(0)), "_sum")).otherwise(F.col("_sum"))
    return rows.select("level", "geo_id", "family", "key", "value", (F.col("value") / F.coalesce(F.nullif(base, F.lit(0)), F.lit(1))).alias("share"))

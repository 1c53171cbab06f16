"""What columns hold: categories, JSON arrays, whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.world import World

#: Most values of a category, least limit of small tables, and the rows that the limit of small tables looks at.
MOST, LEAST, SAMPLE = 64, 8, 4000


def property_profile(population: DataFrame, properties: list[str]) -> DataFrame:
    """property, n_distinct, has_json, usable.

    Usable: no trimmed value begins with ``[`` or ``{``, and there are at most
    min(64, max(8, n / 4)) trimmed and 64 raw values, n being the rows up to
    4000. All rows are looked at, so JSON is found wherever it is.
    """
    long = population.select(F.inline(F.array(*(F.struct(F.lit(p).alias("property"), F.coalesce(F.col(f"`{p}`"), F.lit("")).alias("v")) for p in properties))))
    found = long.groupBy("property").agg(F.count_distinct("v").alias("n_distinct"), F.count_distinct(F.trim("v")).alias("_trimmed"), F.bool_or(F.trim("v").rlike("^[\\[{]")).alias("has_json"), F.count("*").alias("_rows"))
    limit = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.floor(F.least(F.col("_rows"), F.lit(SAMPLE)) / 4)))
    return found.select("property", "n_distinct", "has_json", (~F.col("has_json") & (F.col("_trimmed") <= limit) & (F.col("n_distinct") <= MOST)).alias("usable"))


def categorical_properties(world: World) -> list[str]:
    names = world.properties()
    return sorted(x["property"] for x in property_profile(world["population"], names).filter("usable").collect()) if names else []


def _array_typing(text: Column) -> dict[str, Column]:
    """Aggregates n_rows, n_arrays and all_whole of a text."""
    listed = text.rlike("^\\s*\\[")
    raw, whole = F.from_json(text, "array<string>"), F.from_json(text, "array<bigint>")
    fine = F.coalesce(F.forall(F.arrays_zip(raw.alias("a"), whole.alias("b")), lambda x: x["b"].isNotNull() & x["a"].rlike("^-?[0-9]+$")), F.size(raw) == 0, F.lit(False))
    return {"n_rows": F.count("*"), "n_arrays": F.count_if(listed), "all_whole": F.coalesce(F.bool_and(F.when(listed, fine)), F.lit(False))}


def json_array_typing(rows: DataFrame, column: str) -> DataFrame:
    """n_rows, n_arrays, all_whole: whether a column holds JSON arrays, and whether all elements are whole numbers."""
    return rows.agg(*(v.alias(k) for k, v in _array_typing(F.col(f"`{column}`")).items()))


def json_array_typings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the same for each column as a struct of the column's name: one look at the rows for all."""
    return rows.agg(*(F.struct(*(v.alias(k) for k, v in _array_typing(F.col(f"`{c}`")).items())).alias(c) for c in columns))


def whole_fields(rows: DataFrame, fields: list[str]) -> list[str]:
    """The fields whose values are all whole (nulls don't count)."""
    if not fields:
        return []
    found = rows.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`"))), F.lit(False)).alias(c) for c in fields)).first()
    return [c for c in fields if found[c]]

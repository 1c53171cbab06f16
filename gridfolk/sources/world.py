"""A world: the tables of one synthetic population and its geography."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that every world has; all other columns of a table are properties.
BASE = {
    "population": ("person_id", "geo_unit_id", "age", "sex_code", "row_pos"),
    "venues": ("venue_id", "geo_unit_id", "type_code", "name", "parent_id", "is_residence", "lat", "lon", "rank_in_type", "row_pos"),
    "legs": ("person_id", "venue_id", "leg_idx", "t_board_min", "row_pos"),
}
TABLES = ("geo_units", "population", "venues", "venue_properties", "subsets", "members", "activities", "legs", "registries", "line_stops", "coord_mgu", "features", "labels")


@dataclass(frozen=True)
class World:
    """Named DataFrames; a part that a world doesn't have is missing."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def read(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> World:
        """Open ``path/<name>.parquet`` for the names given; columns and rows are pruned by what is asked later."""
        return World({n: spark.read.parquet(f"{path}/{n}.parquet") for n in names})

    def __getitem__(self, name: str) -> DataFrame:
        if name == "members" and "members" not in self.tables:
            return members_of(self.tables["subsets"])
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables or (name == "members" and "subsets" in self.tables)

    def with_tables(self, **tables: DataFrame) -> World:
        return replace(self, tables=self.tables | tables)

    def registry(self, name: str) -> DataFrame:
        """code, label of one registry. Registries are short lists of labels."""
        return self["registries"].filter(F.col("registry") == name).select("code", "label")

    def labels_of(self, name: str) -> dict[int, str]:
        return {x["code"]: x["label"] for x in self.registry(name).collect()}

    def has_coordinates(self) -> bool:
        return {"lat", "lon"} <= set(self["geo_units"].columns)

    def properties(self) -> list[str]:
        """Text columns of people beyond the base ones."""
        return [f.name for f in self["population"].schema if isinstance(f.dataType, T.StringType) and f.name not in BASE["population"]]

    def relations(self) -> list[str]:
        return [f.name for f in self["population"].schema if isinstance(f.dataType, T.ArrayType)]


def members_of(subsets: DataFrame) -> DataFrame:
    """One row for each member of each subset; empty subsets vanish."""
    return subsets.select("venue_id", "geo_unit_id", "subset_index", "subset_name", F.explode("members").alias("person_id"))


def describe(world: World) -> DataFrame:
    """What a world declares, in one row: its registries and the properties, relations and leg fields it was found to have."""
    listed = world["registries"].groupBy().agg(*(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("registry") == name, F.struct("code", "label")))), lambda x: x["label"]).alias(name)
        for name in ("geo_levels", "venue_types", "subset_names", "activity_names", "sex")
    ))
    names = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    fields = [c for c in world["legs"].columns if c not in BASE["legs"]] if "legs" in world else []
    return listed.withColumns({"properties": names(world.properties()), "relations": names(world.relations()), "leg_fields": names(fields), "has_coordinates": F.lit(world.has_coordinates())})


def units_rows(table: DataFrame, units: list[int]) -> DataFrame:
    """The rows of some units; on a table written by unit only their row groups are read."""
    return table.filter(F.col("geo_unit_id").isin(units))

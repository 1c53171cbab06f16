"""A world made of the star-schema tables: customers live in nation and market segment, suppliers are venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .world import World

#: Labels of the registries, in the order of their codes.
REGISTRIES = {
    "geo_levels": ("region", "nation", "segment"),
    "venue_types": ("household", "company", "train_line", "tube_line"),
    "subset_names": ("A", "N", "R"),
    "activity_names": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "sex": ("male", "female"),
}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def segment_code(column: str) -> F.Column:
    return F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col(column)).cast("long") - 1


def star_world(spark: SparkSession, sf_dir: str) -> World:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, customer, supplier = read("nation"), read("customer"), read("supplier")
    segments = spark.createDataFrame(list(enumerate(SEGMENTS)), "seg long, segment string")
    key = F.col("n_nationkey").cast("long")
    lat, lon = 40 + 0.5 * (key % 5), -3 + 0.5 * F.floor(key / 5)
    unit = ("geo_id long", "level int", "parent_id long", "name string", "lat float", "lon float")
    cast = lambda df: df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in unit)).withColumn("row_pos", F.col("geo_id"))
    regions = read("region").select(F.col("r_regionkey").alias("geo_id"), F.lit(0).alias("level"), F.lit(-1).alias("parent_id"), F.col("r_name").alias("name"), (40.0 + F.col("r_regionkey")).alias("lat"), F.lit(-3.0).alias("lon"))
    nations = nation.select((100 + key).alias("geo_id"), F.lit(1).alias("level"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), lat.alias("lat"), lon.alias("lon"))
    fine = nation.crossJoin(F.broadcast(segments)).select(  # five segments
        (1000 + key * 10 + F.col("seg")).alias("geo_id"), F.lit(2).alias("level"), (100 + key).alias("parent_id"), F.concat("n_name", F.lit("/"), "segment").alias("name"),
        (lat + 0.05 * F.col("seg")).alias("lat"), (lon + 0.05 * F.col("seg")).alias("lon"),
    )
    geo_units = cast(regions).union(cast(nations)).union(cast(fine))

    home = (1000 + F.col("c_nationkey").cast("long") * 10 + segment_code("c_mktsegment")).alias("geo_unit_id")
    balance = F.col("c_acctbal").cast("double")
    population = customer.select(
        F.col("c_custkey").cast("long").alias("person_id"), home, ((F.col("c_custkey") * 7) % 100).cast("float").alias("age"), (F.col("c_custkey") % 2).cast("int").alias("sex_code"),
        F.col("c_mktsegment").alias("mktsegment"), F.when(balance < 0, "low").when(balance < 5000, "mid").otherwise("high").alias("balance_band"), F.col("c_custkey").cast("long").alias("row_pos"),
    )
    place = F.col("s_suppkey").cast("long")
    n = F.col("s_nationkey").cast("long")
    placed = lambda c: F.when(place % 3 != 0, c).cast("float")
    venues = supplier.select(
        place.alias("venue_id"), (100 + n).alias("geo_unit_id"), (place % 4).cast("int").alias("type_code"), F.col("s_name").alias("name"), F.lit(-1).cast("long").alias("parent_id"),
        (place % 4 == 0).alias("is_residence"), placed(40 + 0.5 * (n % 5)).alias("lat"), placed(-3 + 0.5 * F.floor(n / 5)).alias("lon"), F.floor(place / 4).cast("long").alias("rank_in_type"), place.alias("row_pos"),
    )

    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sold = read("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    units = venues.select("venue_id", F.col("geo_unit_id").alias("geo_unit_id"))
    flag = F.array_position(F.array(*map(F.lit, REGISTRIES["subset_names"])), F.col("l_returnflag")).cast("int") - 1
    members = sold.select(F.col("l_suppkey").cast("long").alias("venue_id"), flag.alias("subset_index"), F.col("o_custkey").cast("long").alias("person_id")).distinct().join(units, "venue_id")
    members = members.select("venue_id", "geo_unit_id", "subset_index", F.lit(None).cast("string").alias("subset_name"), "person_id")
    subsets = members.groupBy("venue_id", "geo_unit_id", "subset_index", "subset_name").agg(F.array_sort(F.collect_list("person_id")).alias("members"))
    priority = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    acts = sold.select(F.col("o_custkey").cast("long").alias("person_id"), priority.alias("activity_idx"), F.col("l_suppkey").cast("long").alias("venue_id")).distinct()
    activities = acts.join(population.select("person_id", "geo_unit_id"), "person_id").select("person_id", "geo_unit_id", "activity_idx", "venue_id")
    return World({
        "geo_units": geo_units, "population": population, "venues": venues, "members": members, "subsets": subsets, "activities": activities,
        "registries": spark.createDataFrame([(k, i, v) for k, vs in REGISTRIES.items() for i, v in enumerate(vs)], "registry string, code int, label string"),
    } | _transit(spark, read, nation, supplier) | {"features": _features(nation)})


def _transit(spark: SparkSession, read, nation: DataFrame, supplier: DataFrame) -> dict[str, DataFrame]:
    fleet = supplier.agg(F.count("*").alias("fleet"))
    board = F.hour("ts") * 60.0 + F.minute("ts")
    legs = read("events").crossJoin(F.broadcast(fleet)).select(  # one row
        F.col("user_id").cast("long").alias("person_id"), (F.col("event_id") % F.col("fleet")).cast("long").alias("venue_id"), board.alias("t_board_min"),
        (board + 1 + F.col("event_id") % 30).alias("t_alight_min"), F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("row_pos"),
    )
    stops = supplier.filter(F.col("s_suppkey") % 4 >= 2).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3))))
    stops = stops.withColumn("n", ((F.col("s_suppkey") + F.col("position")) % 25).cast("int"))
    stops = stops.join(F.broadcast(nation.select(F.col("n_nationkey").cast("int").alias("n"), "n_name")), "n")  # nations of the world
    node = F.concat("n_name", F.lit("/"), F.get(F.array(*map(F.lit, SEGMENTS)), F.col("position")))
    line_stops = stops.select(F.col("s_name").alias("line_id"), "position", node.alias("node_mgu"), F.concat(F.lit("stop "), node).alias("name"), (F.col("s_suppkey").cast("long") * 4 + F.col("position")).alias("row_pos"))
    segments = spark.createDataFrame(list(enumerate(SEGMENTS)), "seg long, segment string")
    key = F.col("n_nationkey").cast("long")
    coords = nation.crossJoin(F.broadcast(segments)).select(
        F.concat("n_name", F.lit("/"), "segment").alias("MGU"), (40 + 0.5 * (key % 5) + 0.05 * F.col("seg")).alias("latitude"), (-3 + 0.5 * F.floor(key / 5) + 0.05 * F.col("seg")).alias("longitude"), (key * 10 + F.col("seg")).alias("row_pos"),
    )
    return {"legs": legs, "line_stops": line_stops, "coord_mgu": coords}


def _features(nation: DataFrame) -> DataFrame:
    """A square for each nation but some, as GeoJSON text."""
    key = F.col("n_nationkey").cast("long")
    x, y = -3 + 0.5 * F.floor(key / 5), 40 + 0.5 * (key % 5)
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    square = F.array(F.array(corner(-0.2, -0.2), corner(0.2, -0.2), corner(0.2, 0.2), corner(-0.2, 0.2), corner(-0.2, -0.2)))
    props = F.create_map(F.lit("CODE"), F.upper("n_name"), F.lit("LABEL"), F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), square.alias("coordinates")))
    return nation.filter(key % 7 != 6).select(F.lit("nations").alias("source"), F.lit(None).cast("string").alias("crs"), props.alias("props"), shape.alias("geometry"), key.alias("row_pos"))

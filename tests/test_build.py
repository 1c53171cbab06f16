"""Journeys, shapes, tables by unit, tile and person, running sums, and builds that fail half way."""

import itertools
import json
import os
import random
from urllib.parse import urlparse

import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridfolk.functions.codes import folded, norm_code, norm_name
from gridfolk.operators import geo, inspect, match, prefix, publish, replicate, shards, tiles, transit
from gridfolk.sources.files import boundary_levels, read_features
from gridfolk.sources.star import star_world
from gridfolk.sources.world import World

NAN = float("nan")


def test_journeys_take_the_units_that_legs_name(spark):
    columns = "person_id long, home_geo_unit long, leg_idx int, venue_id long, origin_unit_id double, board_unit_id double, alight_unit_id double, dest_unit_id double"
    rows = [
        (1, 5, 0, 7, 10.0, 11.0, 12.0, 99.0), (1, 5, 1, 8, 98.0, 12.0, 15.0, 13.0),  # left where the next is boarded; inner ends don't count
        (2, 5, 0, 7, -1.0, NAN, None, 3.0), (3, 5, 4, 7, 6.0, 6.0, 6.0, 6.0), (4, 5, 0, 7, None, None, NAN, -2.0), (5, 5, 1, 7, 1.0, 2.0, 1.0, 2.0),
    ]
    legs = spark.createDataFrame(rows, columns)
    lines = spark.createDataFrame([(7, 21), (8, 22)], "venue_id long, geo_unit_id long")
    want = {1: [10, 11, 12, 15, 13], 2: [3], 3: [6], 4: [], 5: [1, 2, 1, 2]}
    assert {r["person_id"]: r["units"] for r in transit.journey_units(legs, lines).collect()} == want
    steps = transit.journey_steps(legs, lines).filter("person_id = 1").orderBy("step").collect()
    assert [(r["step"], r["unit"]) for r in steps] == list(enumerate(want[1]))
    some = legs.drop("origin_unit_id", "alight_unit_id")  # two of the fields
    assert {r["person_id"]: r["units"] for r in transit.journey_units(some, lines).collect()} == {1: [11, 12, 13], 2: [3], 3: [6], 4: [], 5: [2]}
    none = legs.select("person_id", "home_geo_unit", "leg_idx", "venue_id")
    assert {r["person_id"]: r["units"] for r in transit.journey_units(none, lines).collect()}[1] == [5, 21, 22]


def ring(x, y, side, turned=False):
    points = [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]
    return points[::-1] if turned else points


@pytest.mark.parametrize("a, b, c", list(itertools.product([False, True], repeat=3)))
def test_centroids_do_not_depend_on_how_rings_turn(spark, a, b, c):
    shapes = [
        (1, {"type": "MultiPolygon", "coordinates": [[ring(0, 0, 2, a)], [ring(10, 0, 3, b)]]}), (2, {"type": "Polygon", "coordinates": [ring(0, 0, 10, a), ring(1, 1, 4, b), ring(6, 6, 2, c)]}),
        (3, {"type": "Polygon", "coordinates": [ring(0, 0, 2, a)]}), (3, {"type": "Polygon", "coordinates": [ring(4, 0, 2, c)]}), (4, {"type": "Point", "coordinates": [1, 2]}), (5, {"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [4, 4], [0, 0]]]}),
    ]
    got = {r["geo_id"]: tuple(r)[1:] for r in match.boundary_extents(spark.createDataFrame([(i, json.dumps(g)) for i, g in shapes], "geo_id long, geometry string")).collect()}
    middle = (10 * 10 * 5 - 4 * 4 * 3 - 2 * 2 * 7) / 80
    assert got[1] == (round((4 * 1 + 9 * 11.5) / 13, 6), round((4 * 1 + 9 * 1.5) / 13, 6), 0, 0, 13, 3)
    assert got[2] == (middle, middle, 0, 0, 10, 10) and got[3] == (3, 1, 0, 0, 6, 2) and set(got) == {1, 2, 3, 5} and got[5][:2] == (2, 2)


def collection(path, names, crs=None, prop="who"):
    features = [{"type": "Feature", "properties": {prop: n}, "geometry": {"type": "Polygon", "coordinates": [ring(4 * i, 0, 2)]}} for i, n in enumerate(names)]
    if str(path).endswith("l"):
        path.write_text("\n".join(map(json.dumps, features)))
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features} | ({"crs": {"properties": {"name": crs}}} if crs else {})))
    return str(path)


def test_the_configured_crs_decides(spark, tmp_path):
    plain, metres = collection(tmp_path / "a.geojson", ["x", "y"]), collection(tmp_path / "b.geojson", ["x"], "EPSG:3857")
    assert read_features(spark, plain, crs="EPSG:4326").count() == 2 and read_features(spark, metres, crs="urn:ogc:def:crs:OGC:1.3:CRS84").first()["crs"].endswith("CRS84")
    for file, crs in ((plain, "EPSG:27700"), (metres, None)):
        with pytest.raises(Exception, match="not longitude and latitude"):
            read_features(spark, file, crs=crs).collect()
    by_line = collection(tmp_path / "c.geojsonl", ["x", "y", "z"])
    assert read_features(spark, by_line).count() == 3  # known by its name
    (tmp_path / "d.txt").write_text((tmp_path / "c.geojsonl").read_text())
    config = tmp_path / "c.json"
    level = {"file": "d.txt", "prop": "who", "strategy": "code"}
    config.write_text(json.dumps({"levels": {"a": {**level, "lines": True}, "b": level}}))
    found = boundary_levels(str(config))
    assert (found["a"].lines, found["b"].lines) == (True, None) and read_features(spark, found["a"].file, found["a"].lines).count() == 3
    config.write_text(json.dumps({"levels": {"a": {**level, "lines": "yes"}}}))
    with pytest.raises(ValueError, match="a.lines must be"):
        boundary_levels(str(config))


def test_shapes_of_a_part_of_the_world_are_built(spark, tmp_path):
    w, out = star_world(spark, SF), str(tmp_path / "out")
    names = [r["name"] for r in w["geo_units"].filter("level = 1").orderBy("geo_id").collect()]
    collection(tmp_path / "some.geojson", [names[3].lower(), names[7], "elsewhere"])
    collection(tmp_path / "none.geojsonl", ["nobody"])
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"levels": {"nation": {"file": "some.geojson", "prop": "who", "strategy": "code", "crs": "EPSG:4326"}, "region": {"file": "none.geojsonl", "prop": "who", "strategy": "name"}}}))
    few = World({k: v for k, v in w.tables.items() if k in ("geo_units", "population", "registries", "venues", "subsets", "members")})
    got = publish.build(spark, few, out, boundaries=str(config), drilldown=False)["boundary_match"]
    assert got["nation"] | {"rate": None} == {"matched": 2, "world_units": 25, "rate": None, "flag": "✗", "strategy": "code", "prop": "who"} and got["nation"]["rate"] == 2 / 25
    assert got["region"]["matched"] == 0 and {r["geo_id"] for r in spark.read.parquet(f"{out}/extents").collect()} == {103, 107}
    config.write_text(json.dumps({"levels": {"nation": {"file": "some.geojson", "prop": "who", "strategy": "code", "crs": "EPSG:27700"}}}))
    with pytest.raises(Exception, match="longitude"):
        publish.build(spark, few, out, boundaries=str(config), drilldown=False)


def test_venues_without_a_type_are_replicated(spark):
    venues = spark.createDataFrame([(1, 3, 0, 0), (2, 3, None, 5), (3, 3, 0, 1)], "venue_id long, geo_unit_id long, type_code int, rank_in_type long")
    people = spark.createDataFrame([(1, 3)], "person_id long, geo_unit_id long")
    units = spark.createDataFrame([(3, 1.0, 2.0)], "geo_id long, lat float, lon float")
    got = replicate.replicate(World({"venues": venues, "population": people, "geo_units": units}), 3)["venues"].collect()
    assert sorted((r["venue_id"], r["rank_in_type"]) for r in got) == [(1, 0), (2, 5), (3, 1), (5, 2), (6, 5), (7, 3), (9, 4), (10, 5), (11, 5)]


def test_both_transit_inputs_or_neither(spark, tmp_path):
    w = star_world(spark, SF)
    one = World({k: v for k, v in w.tables.items() if k != "coord_mgu"})
    with pytest.raises(ValueError, match="both line_stops and coord_mgu"):
        publish.build(spark, one, str(tmp_path / "out"))
    assert publish.stored_manifest(spark, str(tmp_path / "out")) is None


def test_a_build_that_fails_half_way_is_done_again(spark, tmp_path, monkeypatch):
    w, out, sources = star_world(spark, SF), str(tmp_path / "out"), [f"{SF}/nation.parquet"]
    few = World({k: v for k, v in w.tables.items() if k in ("geo_units", "population", "registries", "venues", "subsets", "members")})
    first = publish.build(spark, few, out, sources, drilldown=False)
    assert publish.build(spark, few, out, sources, drilldown=False) == first

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(publish, "density_pyramid", broken)
        publish.build(spark, few, out, sources, drilldown=False, force=True)
    assert publish.stored_manifest(spark, out) == {}
    again = publish.build(spark, few, out, sources, drilldown=False)
    assert again["build_seconds"] and again["summary"] == first["summary"]


def test_the_build_has_tiles_in_the_order_of_the_curve(spark, tmp_path):
    w, out = star_world(spark, SF), str(tmp_path / "out")
    plain = {r["name"]: r["value"] for r in publish.manifest_summary(w).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = publish.build(spark, w, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {x["name"]: x["value"] for x in manifest["summary"]} == plain and manifest["rows"]["population"] == w["population"].count()
    for name in ("tiles", "line_tiles", "tile_index"):
        table = spark.read.parquet(f"{out}/{name}").withColumn("file", F.input_file_name())
        ranges = sorted(tuple(r) for r in table.groupBy("file").agg(F.min("tile_id"), F.max("tile_id")).select("min(tile_id)", "max(tile_id)").collect())
        assert len(ranges) > 1 and all(a[1] < b[0] for a, b in itertools.pairwise(ranges))
    index = spark.read.parquet(f"{out}/tile_index").orderBy("tile_id").collect()
    assert [r["offset"] for r in index] == list(itertools.accumulate((r["length"] for r in index), initial=0))[:-1] and sum(r["length"] for r in index) == spark.read.parquet(f"{out}/tiles").count()
    cut = spark.read.parquet(f"{out}/line_tiles")
    assert cut.select("line_id").distinct().count() == manifest["transit_summary"]["lines"] and "line_tiles" in manifest["artifacts"]
    presence = {r["geo_unit_id"]: r["rows"] for r in spark.read.parquet(f"{out}/activities_presence").collect()}
    assert presence == {r["geo_unit_id"]: r["rows"] for r in inspect.unit_presence(w["activities"]).collect()}
    unit = 1000
    assert shards.read_shard(spark, f"{out}/population", [unit]).count() == w["population"].filter(F.col("geo_unit_id") == unit).count()


def local(files):
    return [urlparse(f).path for f in files]


def test_a_unit_is_read_from_few_bytes(spark, tmp_path):
    path = str(tmp_path / "people")
    rows = spark.range(60_000).select((F.col("id") % 100).alias("geo_unit_id"), F.col("id").alias("person_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert shards.write_shard(rows.repartition(3), path, within=("person_id",), ids=("person_id",)) == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = sum(os.path.getsize(f) for f in local(spark.read.parquet(path).inputFiles()))
    for units in ([17], [3, 98], [500]):
        read = shards.read_shard(spark, path, units)
        assert read.count() == 600 * sum(u < 100 for u in units)
        if units[0] < 100:
            assert len(read.inputFiles()) < 4 and sum(os.path.getsize(f) for f in local(read.inputFiles())) <= whole * len(units) / 2
    asked = spark.createDataFrame([(17,), (17,), (500,), (None,)], "unit long")
    read = shards.read_shard(spark, path, asked)
    assert read.count() == 600 and len(read.inputFiles()) < 4
    index = shards.shard_index(spark, path)
    assert index.agg(F.sum("rows")).first()[0] == 60_000 and shards.presence_of(index).filter("rows = 600").count() == 100
    for r in index.filter("key = 40").collect():  # the index says where in the file the rows are
        placed = spark.read.parquet(f"{path}/{r['file']}").select("geo_unit_id", F.col("_metadata.row_index").alias("at")).filter("geo_unit_id = 40")
        assert sorted(x["at"] for x in placed.collect()) == list(range(r["first_row"], r["first_row"] + r["rows"]))


def test_a_unit_with_half_of_all_rows_is_several_files(spark, tmp_path):
    path = str(tmp_path / "riders")
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 50 + 10).cast("long").alias("venue_id"), F.col("id").alias("person_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards.write_shard(rows, path, "venue_id", ("person_id",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r["file"]: r["rows"] for r in shards.shard_index(spark, path).filter("key = 5").collect()}
    assert len(files) > 1 and max(files.values()) < 15_000 and shards.read_shard(spark, path, [5], "venue_id").count() == 20_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_person_move_no_people(spark, tmp_path):
    w = star_world(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    names = []
    try:
        names = shards.write_by_person(w, str(tmp_path / "by"), "test_by_person", buckets=4)
        kept = shards.by_person(w, "test_by_person")
        ids = w["population"].select(F.when(F.col("person_id") % 3 == 0, F.col("person_id")).otherwise(-F.col("person_id")).alias("person_id"))
        found = inspect.people_by_ids(kept, ids)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, inspect.people_by_ids(w, ids).collect()))
        assert plan_of(found).count("Exchange hashpartitioning(person_id") <= 2 and "test_by_person_population" in plan_of(found)  # only the ids are dealt
        people, asked = plan_of(found).split("LeftSemi")[1].split("FileScan", 1)
        assert "Exchange hashpartitioning" not in people
        homes = inspect.members_view(kept, inspect.home_units(kept["population"]))
        assert "Exchange hashpartitioning" not in plan_of(homes)
        plain = inspect.members_view(w, inspect.home_units(w["population"]))
        assert homes.exceptAll(plain).count() == 0 and homes.count() == plain.count()
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(c)
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_running_sums_of_sparse_keys_and_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(62) * rng.choice((-1, 1)), rng.choice((None, 0, 3, 7)), 0 if i % 3 else rng.choice((1, None)), f"t{i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "k long, n long, g int, t string").repartition(5)
    placed = inspect.csr_offsets(table, "k", "n", "g", block=100)
    got = {r["t"]: (r["offset"], r["block_end"]) for r in placed.collect()}
    at, want = {}, {}
    for _, n, g, t in sorted(rows, key=lambda r: r[0]):
        want[t] = (at.get(g, 0), at.get(g, 0) + (n or 0))
        at[g] = want[t][1]
    assert got == want
    by_text = {r["t"]: r["offset"] for r in prefix.running(table, "n", ["t", "k"]).collect()}
    total = 0
    for t, n in sorted((r[3], r[1]) for r in rows):
        assert by_text[t] == total
        total += n or 0
    ranged = prefix.cut(table.repartitionByRange(30, "g", "k")).groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 400  # also of the group that has two thirds
    assert prefix.running(table.limit(0), "n", ["k"]).count() == 0


def test_views_are_stretches_of_the_curve(spark, tmp_path):
    zoom, n = 7, 128
    grid = spark.range(n * n).select(F.lit(zoom).alias("z"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"), F.lit("a").alias("layer"), F.xxhash64("id").alias("count"))
    grid = tiles.with_tile_id(grid).cache()
    windows = [(0, 0, 0, 0, 0), (1, 0, 0, n - 1, n - 1), (2, 31, 60, 33, 67), (3, 5, 5, 100, 20), (4, 64, 64, 95, 95), (5, 127, 0, 127, 127)]
    table = spark.createDataFrame(windows, "view int, x0 long, y0 long, x1 long, y1 long").withColumn("z", F.lit(zoom))
    got = {r["view"]: r["largest"] for r in tiles.view_maximum(grid, table).collect()}
    cells = {(r["x"], r["y"]): (r["tile_id"], r["count"]) for r in grid.collect()}
    squares, ranges = {}, {}
    for r in tiles.view_squares(table).collect():
        squares.setdefault(r["view"], []).append((r["first"], r["last"]))
    for r in tiles.view_ranges(tiles.view_squares(table)).collect():
        ranges.setdefault(r["view"], []).append((r["first"], r["last"]))
    for view, x0, y0, x1, y1 in windows:
        inside = [cells[x, y] for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
        assert got[view] == max(c for _, c in inside)
        assert all(any(a <= t <= b for a, b in ranges[view]) for t, _ in inside) and len(squares[view]) <= (tiles.ACROSS + 1) ** 2
        assert sum(b - a + 1 for a, b in ranges[view]) == sum(b - a + 1 for a, b in squares[view]) and len(ranges[view]) <= len(squares[view])
    assert ranges[4] == [(squares[4][0][0], squares[4][0][0] + 1023)] or len(ranges[4]) == 1
    path = str(tmp_path / "tiles")
    tiles.clustered(grid.drop("layer")).write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 500).parquet(path)
    stored = spark.read.parquet(path)
    window = table.filter("view = 2")
    read = tiles.in_view(stored, window)
    assert read.count() == 3 * 8 and "PushedFilters: [" in plan_of(read) and "GreaterThanOrEqual(tile_id" in plan_of(read)
    assert rows_read(read) < n * n / 4


def rows_read(df):
    """Rows that the scan gave, after row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_case_folding_is_that_of_unicode(spark):
    letters = [chr(c) for c in range(0x110000) if chr(c).casefold() != chr(c)]
    words = [*letters, *(f"x{c}Y" for c in letters), "ΟΔΟΣ ὀδός", "Straße STRASSE", "ﬁNE ſoft İstanbul", "plain ASCII", "日本", "é É"]
    got = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", folded(F.col("w")).alias("f"), norm_name(F.col("w")).alias("n")).collect()
    assert all(r["f"] == words[r["i"]].casefold() for r in got) and len(letters) > 1400
    assert [r["n"] for r in got if words[r["i"]].startswith("ﬁNE")] == ["finesoftistanbul"]


def test_codes_are_trimmed_of_any_white_space(spark):
    white = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    words = [f"{w}A{w}{w}ß{w}\u200b" for w in white] + ["\u00a0 x \u3000", "", "  "]
    got = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", norm_code(F.col("w")).alias("c")).collect()
    assert len(white) > 25 and {r["i"]: r["c"] for r in got} == {i: " ".join(w.split()).casefold() for i, w in enumerate(words)}


def test_properties_are_typed_in_one_look(spark):
    rows = spark.createDataFrame([(1, 1, "[1]", '["a"]', "x", "[1"), (2, 1, "", "[2]", "[", None)], "person_id long, geo_unit_id long, a string, b string, c string, `d.e` string")
    assert inspect.json_properties(World({"population": rows})) == {"a": "bigint", "b": "string", "c": "string", "d.e": "string"}


def test_riders_of_sets(spark):
    riders = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (1, 8), (3, 9)], "venue_id long, person_id long")
    sets = spark.createDataFrame([("both", 1), ("both", 2), ("both", 2), ("three", 3), ("none", 4)], "set string, venue_id long")
    assert sorted(tuple(r) for r in transit.riders_of_sets(riders, sets).collect()) == [("both", 7), ("three", 9)]


def test_closure_of_trees_with_gaps(spark):
    units = [(1, 0, -1), (2, 2, 1), (3, 1, 1), (4, 2, 3), (5, 2, 99), (6, 3, 4), (7, 3, None)]  # a level left out, a parent that isn't there, none
    got = {(r["geo_id"], r["level"], r["ancestor_id"]) for r in geo.geo_closure(spark.createDataFrame(units, "geo_id long, level int, parent_id long")).collect()}
    level, parent = {u: x for u, x, _ in units}, {u: p for u, _, p in units}
    want = set()
    for u, _, _ in units:
        at = u
        while at in level:
            want.add((u, level[at], at))
            at = parent[at]
    assert got == want

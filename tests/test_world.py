"""Hand-made worlds and what must be conserved."""

import json
import math
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from gridfolk.functions.codes import age_band, json_array, norm_code, norm_name, registry_map, valid_point
from gridfolk.functions.display import compact, human_number, humanize, one_place, percent, whole_number
from gridfolk.functions.mercator import tile_id
from gridfolk.operators import density, geo, inspect, match, panel, profile, publish, replicate, tiles, transit
from gridfolk.plans.catalogue import ORACLES, QUERIES
from gridfolk.plans.details import wide_levels
from gridfolk.sources.files import COORDINATES, LINE_STOPS, boundary_levels, read_csv, read_features
from gridfolk.sources.star import star_world
from gridfolk.sources.world import World, members_of


@pytest.fixture(scope="module")
def world(spark):
    registries = [("geo_levels", 0, "parish"), ("venue_types", 0, "workshop"), ("subset_names", 0, "staff"), ("activity_names", 0, "craft"), ("sex", 0, "male"), ("sex", 1, "female")]
    return World({
        "geo_units": spark.createDataFrame([(3, 0, -1, "Northfold", 51.0, 4.0, 0), (4, 0, -1, "Southmere", 50.0, 4.5, 1), (9, 0, -1, "Emptyholm", 49.0, 5.0, 2)], "geo_id long, level int, parent_id long, name string, lat float, lon float, row_pos long"),
        "population": spark.createDataFrame([(101, 3, 33.0, 0, "teal", 0), (102, 3, 41.0, 1, "plum", 1), (103, 4, 52.0, 0, "teal", 2), (104, 4, float("nan"), 1, "sand", 3), (105, 4, 17.0, 1, "plum", 4)], "person_id long, geo_unit_id long, age float, sex_code int, colour string, row_pos long"),
        "venues": spark.createDataFrame([(7, 3, 0, None, -1, None, None, None, 0, 0)], "venue_id long, geo_unit_id long, type_code int, name string, parent_id long, is_residence boolean, lat float, lon float, rank_in_type long, row_pos long"),
        "subsets": spark.createDataFrame([(7, 3, 0, None, [101, 103]), (7, 3, 1, None, [])], "venue_id long, geo_unit_id long, subset_index int, subset_name string, members array<long>"),
        "activities": spark.createDataFrame([(101, 3, 0, 7), (103, 4, 0, 7), (104, 4, 7, 99)], "person_id long, geo_unit_id long, activity_idx int, venue_id long"),
        "registries": spark.createDataFrame(registries, "registry string, code int, label string"),
    })


def test_members_and_homes(world):
    got = {r["person_id"]: r["home_geo_unit"] for r in inspect.members_view(world, inspect.home_units(world["population"])).collect()}
    assert got == {101: 3, 103: 4}
    assert {(r["home_geo_unit"], r["subset"]) for r in inspect.members_view(world, None).collect()} == {(-1, "staff")}


def test_lookups_by_id(spark, world):
    ids = spark.createDataFrame([(103,), (101,), (101,), (999,)], "person_id long")
    assert sorted(r["person_id"] for r in inspect.people_by_ids(world, ids).collect()) == [101, 103]
    (row,) = inspect.activities_by_ids(world, ids.filter("person_id = 103")).collect()
    assert (row["activity"], row["venue_id"], row["venue_type"], row["venue_name"]) == ("craft", 7, "workshop", "7")


def test_unknown_codes_and_venues_are_kept(world):
    row = inspect.activities_view(world).filter("person_id = 104").first()
    assert (row["activity"], row["venue_geo_unit"], row["venue_type"], row["venue_name"]) == ("7", -1, "", "")


def test_nan_age_counts_in_the_last_band_and_adds_nothing(world):
    row = panel.panel_people(world, geo.geo_closure(world["geo_units"])).filter("geo_id = 4").first()
    assert (row["people"], row["mean_age"], row["age:65+"], row["age:45-64"], row["age:0-17"]) == (3, 23.0, 1, 1, 1)


def test_json_properties_become_arrays(world):
    tagged = world.with_tables(population=world["population"].withColumns({"seen": F.when(F.col("person_id") == 101, "[1, 2]").when(F.col("person_id") == 102, "[x").otherwise(""), "named": F.lit('["a", "b"]')}))
    arrays = inspect.json_properties(tagged)
    assert arrays["named"] == "string" and set(arrays) == {"seen", "named"}
    rows = {r["person_id"]: r for r in inspect.people_view(tagged, {**arrays, "seen": "bigint"}).collect()}
    assert rows[101]["seen"] == [1, 2] and rows[102]["seen"] == [] and rows[103]["seen"] == [] and rows[105]["named"] == ["a", "b"] and rows[104]["colour"] == "sand"


def test_offsets_do_not_depend_on_blocks(spark):
    rows = [(k, 3 * k % 5 or None, k % 2 if k % 7 else None) for k in range(60)]
    table = spark.createDataFrame(rows, "k long, n long, g long")
    got = {r["k"]: (r["offset"], r["block_end"]) for r in inspect.csr_offsets(table, "k", "n", "g", block=8).collect()}
    at, want = {}, {}
    for k, n, g in rows:
        want[k] = (at.get(g, 0), at.get(g, 0) + (n or 0))
        at[g] = want[k][1]
    assert got == want


def test_pages_are_clamped(spark):
    rows = spark.createDataFrame([(g, i) for g, n in ((1, 5), (2, 2), (None, 3)) for i in range(n)], "g long, i long")
    got = sorted(((r["g"] or 0), r["i"]) for r in inspect.page(rows, ["i"], "g", 2, size=2).collect())
    assert got == [(0, 2), (1, 4), (2, 0), (2, 1)]


def test_people_and_venues_are_conserved(spark):
    w = star_world(spark, SF)
    closure = geo.geo_closure(w["geo_units"])
    people = panel.panel_people(w, closure).groupBy("level").agg(F.sum("people").alias("n")).collect()
    assert {r["n"] for r in people} == {w["population"].count()} and len(people) == 3
    long = panel.panel_long(w, closure).groupBy("level", "family").agg(F.sum("value").alias("n"))
    sums = {(r["level"], r["family"]): r["n"] for r in long.collect()}
    assert sums[0, "sex"] == w["population"].count() and sums[0, "p"] == 2 * sums[0, "sex"] and sums[0, "venues"] == w["venues"].count()
    assert (2, "venues") not in sums  # venues sit at a coarser level


def test_density_is_conserved_at_each_resolution(spark):
    w = star_world(spark, SF)
    pyramid = density.density_pyramid(density.finest_density(density.weighted_points(w)))
    totals = {(r["layer"], r["res"]): r["n"] for r in pyramid.groupBy("layer", "res").agg(F.sum("count").alias("n")).collect()}
    assert {totals["people", r] for r in (3, 5, 7, 9)} == {w["population"].count()}
    assert {totals["venues", r] for r in (3, 5, 7, 9)} == {w["venues"].count()}


def test_keys_and_texts(spark):
    df = spark.createDataFrame([("  Málaga\t Straße ",)], "s string")
    assert df.select(norm_code(F.col("s")).alias("c"), norm_name(F.col("s")).alias("n")).first()[:] == ("málaga strasse", "mlagastrasse")
    one = spark.range(1)
    shown = one.select(humanize(F.lit("private_household")), humanize(F.lit("")), compact(F.lit(12345.0)), compact(F.lit(1234.0)), compact(F.lit(999.0)), percent(F.lit(1.0), F.lit(0.0)), human_number(F.lit("60M"))).first()
    assert shown[:] == ("Private Household", "—", "12k", "1.2k", "999", "0%", 60_000_000)
    assert one.select(registry_map(F.lit("male:0,female:1,x:"))).first()[0] == {0: "male", 1: "female"}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in (-1.0, 17.9, 18.0, 1000.0, float("nan"))], "a float").select(age_band(F.col("a"))).collect()] == ["0-17", "0-17", "18-29", "65+", "65+"]
    texts = spark.createDataFrame([("[1,2]",), ("",), ("[]",), ("[x",), (None,)], "s string")
    assert [r[0] for r in texts.select(json_array(F.col("s"), "bigint")).collect()] == [[1, 2], [], [], [], []]
    points = spark.createDataFrame([(91.0, 0.0), (40.0, float("nan")), (None, 1.0), (40.0, -3.0)], "lat double, lon double")
    assert [r[0] for r in points.select(valid_point(F.col("lat"), F.col("lon"))).collect()] == [False, False, False, True]


def test_ties_of_short_numbers(spark, tmp_path):
    """As the reference's toFixed: a double halfway between two texts goes up, one just below such a number (2.05, 1.15) goes down; no total hangs on the order of adding."""
    duckdb = pytest.importorskip("duckdb")
    nan, inf = float("nan"), float("inf")
    prices = {
        1: [12500.0], 2: [13500.0], 3: [1150.0], 4: [1250.0], 5: [2050000.0], 6: [3250000.0], 7: [-12500.0], 8: [-1250.0], 9: [-3.0], 10: [None], 11: [nan, 1.0], 12: [inf, 1.0], 13: [5.0, None],
        14: [12.4e9, 0.1e9], 15: [0.1, 0.2, 0.3, 12498.9], 16: [12498.9, 0.3, 0.2, 0.1], 17: [1e25, -1e25], 18: [0.004] * 1000, 19: [2e13, -12500.5], 20: [-0.3], None: [1350.0],
    }
    short = {
        1: "13k", 2: "14k", 3: "1.1k", 4: "1.3k", 5: "2.0M", 6: "3.3M", 7: "-13k", 8: "-1.3k", 9: "-3", 10: "—", 11: "—", 12: "—", 13: "5",
        14: "13B", 15: "13k", 16: "13k", 17: "0", 18: "4", 19: "20000B", 20: "0", None: "1.4k",
    }
    rows = [(k, p) for k, ps in prices.items() for p in ps]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    found, told = QUERIES["format_numbers"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["format_numbers"]).df()
    assert rows_of(found) == rows_of(told)
    assert {None if k != k else int(k): v for k, v in zip(found["o_custkey"], found["short"])} == short


def test_total_that_adds_up_to_a_half_in_one_order_only(spark, tmp_path):
    """As doubles, these four prices are 1249999.5 in one order and a little less in the other: 1250000 or 1249999."""
    orders = [(171174.92, 79134.9, 332481.85, 667207.83), (332481.85, 667207.83, 171174.92, 79134.9)]
    for i, prices in enumerate(orders):
        spark.createDataFrame([(1, p) for p in prices], "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/{i}/orders.parquet")
    assert [QUERIES["format_numbers"](spark, f"{tmp_path}/{i}").first()["short"] for i in (0, 1)] == ["1.3M", "1.3M"]


def test_one_place_goes_by_the_exact_value(spark):
    """Against Python's exact decimals of doubles."""
    values = [x / 20 for x in range(-400, 401)] + [0.049999999999999996, 0.03, 1e-300, 2.0**51 + 0.5, 1e300, 1099511627776.25]
    exact = lambda v, to: str(Decimal(v).quantize(Decimal(to), ROUND_HALF_UP, Context(prec=400)))
    shown = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_place(F.col("v")).alias("one"), whole_number(F.col("v")).alias("whole")).collect()
    assert [(r["v"], r["one"]) for r in shown if abs(r["v"]) < 1e15] == [(v, exact(v, "0.1")) for v in values if abs(v) < 1e15]
    assert [float(r["whole"]) for r in shown] == [float(exact(v, "1")) for v in values]


def test_property_guard(spark):
    rows = spark.createDataFrame([(str(i), "a" if i % 2 else "b", "[1]" if i == 50 else "x") for i in range(100)], "many string, two string, json string")
    got = {r["property"]: r["usable"] for r in profile.property_profile(rows, ["many", "two", "json"]).collect()}
    assert got == {"many": False, "two": True, "json": False}


def test_json_arrays_are_typed_over_all_rows(spark):
    whole = spark.createDataFrame([("[1,2]",), ("[]",), (None,)], "s string")
    mixed = whole.union(spark.createDataFrame([('["a"]',)], "s string"))
    assert profile.json_array_typing(whole, "s").first()["all_whole"] and not profile.json_array_typing(mixed, "s").first()["all_whole"]


def test_hilbert_ids_are_distinct_and_neighbours_touch(spark):
    tiles_ = spark.range(64).select(F.lit(3).alias("z"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = sorted((r["t"], r["x"], r["y"]) for r in tiles_.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("t"), "x", "y").collect())
    assert [t for t, _, _ in got] == list(range(21, 85))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))


def test_line_tiles_keep_the_length_of_lines(spark):
    stops = spark.createDataFrame([("L", 1, 0, -3.0, 40.0), ("L", 1, 1, -1.0, 41.0), ("L", 1, 2, 2.0, 40.5)], "line_id string, venue_id long, position int, lon double, lat double")
    got = tiles.line_tiles(stops, (8, 8)).collect()

    def length(points):
        return sum(math.dist((a["px"], a["py"]), (b["px"], b["py"])) for a, b in zip(points, points[1:], strict=False))

    lines = transit.segment_lengths(stops.groupBy("line_id", "venue_id").agg(F.array_sort(F.collect_list(F.struct("position", "lon", "lat"))).alias("stops")))
    assert len(got) > 3
    assert sum(length(r["points"]) for r in got) == pytest.approx(lines.first()["length"] * 2**8, rel=1e-3)


def test_legs_without_numbers_follow_boarding_and_ties_the_file(spark):
    w = star_world(spark, SF)
    legs = spark.createDataFrame([(1, 2, 9.0, 0), (1, 2, 5.0, 1), (1, 3, 5.0, 2), (1, 0, 1.0, 3)], "person_id long, venue_id long, t_board_min double, row_pos long")
    got = transit.rider_legs(w.with_tables(legs=legs), transit.line_venues(w), None).orderBy("leg_idx").collect()
    assert [(r["leg_idx"], r["venue_id"], r["t_board_min"]) for r in got] == [(0, 2, 5.0), (1, 3, 5.0), (2, 2, 9.0)]
    numbered = legs.withColumn("leg_idx", F.col("row_pos").cast("int"))
    got = transit.rider_legs(w.with_tables(legs=numbered), transit.line_venues(w), None, typed=True).orderBy("leg_idx").collect()
    assert [r["venue_id"] for r in got] == [2, 2, 3] and isinstance(got[0]["t_board_min"], int)


def test_replicas_are_disjoint(world):
    big = replicate.replicate(world.with_tables(members=members_of(world["subsets"])), 9)
    assert big["population"].count() == 10 and big["population"].select("person_id").distinct().count() == 10
    assert {r["parent_id"] for r in big["geo_units"].collect()} == {-1}
    homes = inspect.home_units(big["population"])
    assert inspect.members_view(big, homes).filter("home_geo_unit < 0").count() == 0
    assert inspect.members_view(big, homes).count() == 4


def features_file(path, prop, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {prop: k, "n": 1, "x": None}, "geometry": g} for k, g in features]}), encoding="utf-8")
    return str(path)


def square(x):
    return {"type": "Polygon", "coordinates": [[[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]]}


def test_boundaries(spark, tmp_path):
    units = spark.createDataFrame([(1, 1, -1, "Aa", 0), (2, 1, -1, "AA ", 1), (3, 1, -1, "Bb", 2)], "geo_id long, level int, parent_id long, name string, row_pos long")
    features = [("aa", square(0)), ("aa", square(2)), ("zz", square(9)), ("bb", {"type": "Polygon", "coordinates": "bad"})]
    read = read_features(spark, features_file(tmp_path / "gränser.geojson", "KOD", features))
    assert read.first()["props"] == {"KOD": "aa", "n": "1", "x": ""}
    (row,) = match.boundary_extents(match.matched_features(units, read, 1, "KOD", "code")).collect()
    assert row[:] == (1, 2.0, 1.0, 0.0, 0.0, 4.0, 2.0)
    assert match.collisions(units, "code").first()["collisions"] == 1
    report = match.match_report(units, read)
    assert match.poorest_rate(report) == 1.0
    with pytest.raises(ValueError, match="level 1"):
        match.poorest_rate(match.match_report(units.withColumn("name", F.lit("none")), read))
    for name, text, said in (("t.json", '{"type": "Topology", "features": []}', "TopoJSON"), ("m.json", '{"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3857"}}, "features": [{"properties": {}, "geometry": null}]}', "longitude")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=said):
            read_features(spark, str(tmp_path / name)).collect()


def test_boundary_configuration(tmp_path):
    config = tmp_path / "gränser.json"
    (tmp_path / "ö.geojson").write_text("{}")
    fine = {"file": "ö.geojson", "prop": "KOD", "strategy": "Code"}
    config.write_text(json.dumps({"levels": {"LÄN": fine}}, ensure_ascii=False), encoding="utf-8")
    got = boundary_levels(str(config))["LÄN"]
    assert (got.strategy, got.prop, got.file) == ("code", "KOD", str(tmp_path / "ö.geojson"))
    wrong = {"A": {**fine, "strategy": "guess"}, "B": {"file": "none.geojson", "prop": 3}, "C": "text", "D": {**fine, "crs": 4}}
    for text, said in ((json.dumps({"levels": wrong}), ["A.strategy", "B.file .* isn't there", "B.prop must be", "B.strategy is missing", "C.file is missing", "D.crs must be"]), ('{"levels": {}}', ["no levels"]), ("[1]", ["no levels"]), ("{", ["no JSON"])):
        config.write_text(text)
        for part in said:
            with pytest.raises(ValueError, match=part):
                boundary_levels(str(config))


@pytest.mark.parametrize("bom", ["", "\ufeff"])
def test_stops_with_accents(spark, tmp_path, bom):
    stops, coords = tmp_path / "stops.csv", tmp_path / "coords.csv"
    names = ["Łódź Główna", "Besançon Viotte", "Zürich Oerlikon", "Ærø"]
    stops.write_text(bom + "line_id,position,node_mgu,name\n" + "".join(f"Q7,{i},k{i},{n}\n" for i, n in enumerate(names)), encoding="utf-8")
    coords.write_text(bom + "MGU,latitude,longitude\n" + "".join(f"k{i},51.{i},7.{i}\n" for i in range(4)), encoding="utf-8")
    got = transit.line_geometry(read_csv(spark, str(stops), LINE_STOPS), read_csv(spark, str(coords), COORDINATES)).first()
    assert [s["name"] for s in got["stops"]] == names and got["stops"][3]["lat"] == 51.3


def test_build_with_boundaries(spark, tmp_path, world):
    file = features_file(tmp_path / "p.geojson", "who", [("northfold", square(0)), ("SOUTHMERE", square(4)), ("elsewhere", square(8))])
    config, out = tmp_path / "c.json", str(tmp_path / "out")
    level = {"file": "p.geojson", "prop": "who", "strategy": "code"}
    config.write_text(json.dumps({"levels": {"parish": level, "unheard of": level}}))
    whole = world.with_tables(members=members_of(world["subsets"]))
    manifest = publish.build(spark, whole, out, [file], boundaries=str(config))
    assert manifest["boundary_match"] == {"parish": {"matched": 2, "world_units": 3, "rate": 2 / 3, "flag": "~", "strategy": "code", "prop": "who"}} and {"extents", "boundary_tiles", "panel_wide"} <= set(manifest["artifacts"])
    wide = {r["geo_id"]: r for r in spark.read.parquet(f"{out}/panel_wide").collect()}
    assert (wide[3]["cx"], wide[4]["minx"], wide[4]["people"]) == (1.0, 4.0, 3)
    assert {r["geo_id"] for r in spark.read.parquet(f"{out}/boundary_tiles").collect()} == {3, 4}
    config.write_text(json.dumps({"levels": {"parish": {**level, "prop": "n"}}}))  # matches nothing, which is told and no more
    assert publish.build(spark, whole, out, [file], boundaries=str(config))["boundary_match"]["parish"]["matched"] == 0
    with pytest.raises(ValueError, match="match"):
        match.poorest_rate(match.match_report(whole["geo_units"], read_features(spark, file), "name").withColumn("rate", F.lit(0.0)))


def test_build_is_whole_and_idempotent(spark, tmp_path):
    w, out = star_world(spark, SF), str(tmp_path / "out")
    first = publish.build(spark, w, out, [f"{SF}/nation.parquet"])
    assert {"panel", "panel_wide", "population", "density", "tile_index", "riders", "chains", "line_features", "sample_riders"} <= set(first["artifacts"])
    features = [json.loads(r[0]) for r in spark.read.text(f"{out}/line_features").collect()]
    assert len(features) == first["transit_summary"]["lines"] and all(f["type"] == "Feature" for f in features)
    assert {r["level"] for r in spark.read.parquet(f"{out}/panel_wide").collect()} == {0, 1, 2}
    assert spark.read.parquet(f"{out}/population").count() == w["population"].count()
    assert publish.build(spark, w, out, [f"{SF}/nation.parquet"]) == first
    assert publish.build(spark, w, out, [f"{SF}/nation.parquet"], drilldown=False) != first
    ids = [r["tile_id"] for r in spark.read.parquet(f"{out}/tile_index").collect()]
    assert len(ids) == len(set(ids))


def test_journeys_drop_unknown_units_and_repeats(spark):
    legs = spark.createDataFrame([(1, 5, 0, 7), (1, 5, 1, 8), (1, 5, 2, 99)], "person_id long, home_geo_unit long, leg_idx int, venue_id long")
    lines = spark.createDataFrame([(7, 5), (8, 6)], "venue_id long, geo_unit_id long")
    assert transit.journey_units(legs, lines).first()["units"] == [5, 6]


def test_a_wide_panel_of_one_level_is_that_of_all_levels(spark):
    w = star_world(spark, SF)
    one = panel.panel_wide(w, geo.geo_closure(w["geo_units"]), 1)
    names = sorted(one.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*(F.col(f"`{c}`") for c in names)).collect())
    assert rows(one) == rows(wide_levels(w).filter("level = 1"))

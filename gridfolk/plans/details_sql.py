"""SQL for DuckDB that gives the rows of :mod:`gridfolk.plans.details`, and of the line queries."""

from __future__ import annotations

import math

from ..functions.codes import AGE_BANDS
from ..functions.hexgrid import RESOLUTIONS, edge
from ..functions.mercator import EXTENT, ZOOM_OF
from ..operators.tiles import LINE_ZOOMS
from .star_sql import _LONG, _PEOPLE, FINEST, HILBERT, REPLICAS, SEX, TILES, centre, plane, q

_MOVES = f""",
box as (select min(lat)::double as lat0, min(lon)::double as lon0, (max(lat)::double - min(lat)::double) * 1.15::double as up, (max(lon)::double - min(lon)::double) * 1.15::double as right_ from geo_units)"""
_PLACE = "round(coalesce(({c} + {step} * {span})::float, -999)::double, 3) as {c}"
_PLACES = ", ".join([_PLACE.format(c="lat", step="(rep // ceil(sqrt(k))::bigint)", span="up"), _PLACE.format(c="lon", step="(rep % ceil(sqrt(k))::bigint)", span="right_")])
_K = REPLICAS.replace("as rep, people", "as rep, k, people")


def _corner(res: int, k: int) -> str:
    """Pixel corner ``k`` of a tile's hexagon."""
    side, cx, cy = edge(res), *centre(res)
    dx, dy, n = side * math.cos(math.pi / 180 * (60 * k - 30)), side * math.sin(math.pi / 180 * (60 * k - 30)), 2 ** ZOOM_OF[res]
    unit = lambda c, d, t: f"round_even(({c} + {d!r}::double) * {n} * {EXTENT} - {t} * {EXTENT}, 0)::bigint"
    return f"{unit(cx, dx, 'x')} || ' ' || {unit(cy, dy, 'y')}"


_RINGS = "case res " + " ".join(f"when {res} then concat_ws(',', {', '.join(_corner(res, k) for k in range(6))})" for res in RESOLUTIONS) + " end"
_TILE_LAT = "degrees(atan((exp({a}) - exp(-({a}))) / 2))"
_lat_of = lambda y: _TILE_LAT.format(a=f"{math.pi!r}::double * (1 - 2 * ({y}) / pow(2.0::double, z))")
_ALL_TILES = "(select z, x, y, count(*) as n from tiles group by all)"

_COUNTED_STOPS = """,
exact as (
  select s_name as line_id, s_suppkey as venue_id, p.position, s.node, n.lon + 0.05::double * p.position as lon, n.lat + 0.05::double * p.position as lat
  from supplier cross join (select unnest(range(0, 4)) as position) p join nat n on n.k = (s_suppkey + p.position) % 25 join stops s on s.venue_id = s_suppkey and s.position = p.position where s_suppkey % 4 >= 2)"""
_WX, _WY = plane("{lat}", "{lon}")
_wx, _wy = (lambda c: _WX.format(lat="0", lon=c)), (lambda c: _WY.format(lat=c, lon="0"))
_SIDE = lambda d, a: f"case when {d} = 0 and ({a} < 0 or {a} > {EXTENT}) then 2 when {d} = 0 then 0 else least(-{a} / nullif({d}, 0), ({EXTENT} - {a}) / nullif({d}, 0)) end"
_FAR = lambda d, a: f"case when {d} = 0 and ({a} < 0 or {a} > {EXTENT}) then -1 when {d} = 0 then 1 else greatest(-{a} / nullif({d}, 0), ({EXTENT} - {a}) / nullif({d}, 0)) end"
_POINT = lambda t: f"""'{{"px":' || round_even(ax + {t} * dx, 0)::bigint || ',"py":' || round_even(ay + {t} * dy, 0)::bigint || '}}'"""
_LINE_TILES = _COUNTED_STOPS + f""",
pieces as (
  select line_id, venue_id, row_number() over o as n, lon as x0, lat as y0, lead(lon) over o as x1, lead(lat) over o as y1 from exact window o as (partition by line_id order by position)),
zoomed as (
  select *, {_wx("x0")} * pow(2.0, z) as fx0, {_wx("x1")} * pow(2.0, z) as fx1, {_wy("y0")} * pow(2.0, z) as fy0, {_wy("y1")} * pow(2.0, z) as fy1
  from pieces cross join (select unnest(range({LINE_ZOOMS[0]}, {LINE_ZOOMS[1] + 1}))::integer as z) where x1 is not null),
columns_ as (select *, unnest(range(floor(least(fx0, fx1))::bigint, floor(greatest(fx0, fx1))::bigint + 1)) as x from zoomed),
boxed as (select *, unnest(range(floor(least(fy0, fy1))::bigint, floor(greatest(fy0, fy1))::bigint + 1)) as y from columns_),
ends as (select *, fx0 * {EXTENT} - x * {EXTENT} as ax, fy0 * {EXTENT} - y * {EXTENT} as ay, fx1 * {EXTENT} - x * {EXTENT} as bx, fy1 * {EXTENT} - y * {EXTENT} as by_ from boxed),
moved as (select *, bx - ax as dx, by_ - ay as dy from ends),
cut as (select *, greatest(0.0, {_SIDE("dx", "ax")}, {_SIDE("dy", "ay")}) as t0, least(1.0, {_FAR("dx", "ax")}, {_FAR("dy", "ay")}) as t1 from moved),
fresh as (
  select *, case when lag(n) over o = n - 1 and lag(t1) over o = 1.0 and t0 = 0.0 then 0 else 1 end as is_new from cut where t0 < t1 window o as (partition by line_id, z, x, y order by n)),
numbered as (select *, sum(is_new) over (partition by line_id, z, x, y order by n)::integer as part from fresh)"""

_ODD = """,
odd_population as (
  select person_id, geo_unit_id, case when person_id % 10 = 0 then 'NaN'::float when person_id % 13 = 0 then -age - 1 else age end as age, case when person_id % 9 = 0 then 5 else sex_code end as sex_code,
    case when person_id % 8 = 0 then '' when person_id % 6 = 0 then null else mktsegment end as mktsegment, balance_band
  from population where person_id % 11 <> 0),
odd_venues as (
  select venue_id, geo_unit_id, case when venue_id % 7 = 0 then 99 else type_code end as type_code, name, 0 as again from venues
  union all select venue_id, 1000, case when venue_id % 2 = 0 then 1 else 99 end, null, 1 from venues where venue_id % 5 = 0),
odd_index as (select venue_id, arg_max(geo_unit_id, again) as unit, arg_max(type_code, again) as code, case when max(again) = 1 then null else max(name) end as name from odd_venues group by 1)"""
_ODD_PEOPLE = _ODD + f""",
banded as (select *, case {" ".join(f"when age < {top} then '{label}'" for top, label in AGE_BANDS[:-1])} else '{AGE_BANDS[-1][1]}' end as band from odd_population)"""
_ODD_LONG = _ODD + """,
leaf as (
  select geo_unit_id, 'sex' as family, case sex_code when 0 then 'male' else 'female' end as key, count(*) as value from odd_population where sex_code < 2 group by all
  union all select geo_unit_id, 'p', 'mktsegment=' || case when coalesce(mktsegment, '') = '' then '(none)' else mktsegment end, count(*) from odd_population group by all
  union all select geo_unit_id, 'p', 'balance_band=' || balance_band, count(*) from odd_population group by all
  union all select geo_unit_id, 'venues', label, count(*) from odd_venues join types on code = type_code group by all
  union all select m.geo_unit_id, 'occ', label, count(*) from members m join odd_index v on v.venue_id = m.venue_id join types t on t.code = v.code group by all),
long as (select c.level, c.ancestor_id as geo_id, family, key, sum(value)::bigint as value from leaf join closure c on c.geo_id = geo_unit_id group by all)"""
_VENUE_OF = "case when a.person_id % 4 = 0 then a.venue_id + 1000000000 else a.venue_id end"

# The units of journeys as they are told: origin of the first leg, where each is boarded and left, destination of the last.
_JOURNEYS = """,
told as (
  select g.person_id, row_number() over (partition by g.person_id order by t_board_min, row_pos) as leg, count(*) over (partition by g.person_id) as legs,
    1000 + g.person_id % 25 * 10 + row_pos % 5 as origin, case when row_pos % 7 <> 0 then 100 + row_pos % 25 end as board,
    case when row_pos % 11 = 0 then null when row_pos % 5 = 0 then 100 + row_pos % 25 else 100 + (row_pos + 1) % 25 end as alight, case when row_pos % 3 <> 0 then 1000 + (g.person_id + row_pos) % 25 * 10 end as dest
  from legs g join lines l on l.venue_id = g.venue_id),
passed as (
  select person_id, 0 as pos, origin as unit from told where leg = 1 union all select person_id, 2 * leg, board from told union all select person_id, 2 * leg + 1, alight from told
  union all select person_id, 2 * leg + 2, dest from told where leg = legs),
seen as (select *, lag(unit) over (partition by person_id order by pos) as before from passed where unit is not null),
stops_of as (select person_id, (row_number() over (partition by person_id order by pos) - 1)::integer as step, unit from seen where before is null or before <> unit)"""
# Squares by their sides and middles, not by their corners: what has an area, and what is taken from it.
_SHAPES = """
with squares as (
  select n_nationkey as nation, 3.0 * n_nationkey as x, 0.0 as y, 2.0 + n_nationkey % 3 as side, 1 as role from nation
  union all select n_nationkey, 3.0 * n_nationkey + 0.25, 0.5, 1, -1 from nation where n_nationkey % 4 <> 3
  union all select n_nationkey, 3.0 * n_nationkey + 10, 20, 3, 1 from nation
  union all select s_nationkey, s_suppkey % 100, 50 + 2 * (s_suppkey // 100), 1.5, 1 from supplier),
d as (select nation, x::double as x, y::double as y, side::double as side, role from squares)
select 100 + nation::bigint as geo_id, round(sum(role * side * side * (x + side / 2)) / sum(role * side * side), 6) as cx, round(sum(role * side * side * (y + side / 2)) / sum(role * side * side), 6) as cy,
  min(x) as minx, min(y) as miny, max(x + side) as maxx, max(y + side) as maxy
from d group by nation"""
_VIEWS = f""",
boxes as (select geo_id as view, lat::double as lat, lon::double as lon, 0.05::double + 0.45::double * (geo_id % 5) as half from geo_units where level = 1),
windows as (
  select view, greatest(0, floor((lon - half + 180) / 360 * 1024))::bigint as x0, least(1023, floor((lon + half + 180) / 360 * 1024))::bigint as x1,
    floor({plane("(lat + half)", "0.0")[1]} * 1024)::bigint as y0, floor({plane("(lat - half)", "0.0")[1]} * 1024)::bigint as y1 from boxes)"""
_WIDE = [("sex", "male"), ("sex", "female"), *((f, t) for f in ("venues", "occ") for t in ("household", "company", "train_line", "tube_line")), *(("p", f"mktsegment={s}") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), *(("p", f"balance_band={b}") for b in ("low", "mid", "high"))]

DETAIL_ORACLES = {
    "journey_stops": q("select person_id, step, unit from stops_of", _JOURNEYS),
    "journey_stop_points": q("select person_id, step, geo_id, name, case when step = 0 then 'start' when step = n - 1 then 'end' else 'via' end as role from (select person_id, step, unit as geo_id, name, count(*) over (partition by person_id) as n from stops_of join geo_units on geo_id = unit) where n > 1", _JOURNEYS),
    "boundary_centroids": _SHAPES,
    "replicate_untyped": q("select venue_id + rep * places as venue_id, geo_unit_id + rep * units as geo_unit_id, kind as type_code, rank_in_type + rep * case when kind is null then 0 else count(*) over (partition by kind, rep) end as rank_in_type from (select *, case when venue_id % 3 <> 0 then type_code end as kind from venues), rep", REPLICAS),
    "tile_directory": q("select t.d as tile_id, t.z, t.x, t.y, (sum(n.n) over (order by t.d) - n.n)::bigint as \"offset\", n.n as length from turns t join (select z, x, y, count(*) as n from tiles group by all) n on n.z = t.z and n.x = t.x and n.y = t.y where t.k = 0", FINEST + TILES + HILBERT).replace("with ", "with recursive ", 1),
    "view_maximum": q("select view, layer, max(count) as largest from windows join tiles on z = 10 and x between x0 and x1 and y between y0 and y1 group by all", FINEST + TILES + _VIEWS),
    "csr_offsets_hashed": q("select key, n, sex_code, coalesce(sum(n) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", sum(n) over (o rows between unbounded preceding and current row)::bigint as block_end from (select ('0x' || substr(md5(person_id::varchar), 1, 15))::bigint as key, person_id % 9 as n, sex_code from population) window o as (partition by sex_code order by key)"),
    "people_of_orders": q(f"select person_id, geo_unit_id, age, {SEX}, mktsegment, balance_band from population where person_id in (select o_custkey from orders)"),
    "riders_of_sets": q('select d.geo_unit_id as "set", d.person_id from (select l.geo_unit_id, r.person_id, count(distinct r.venue_id) as n from riders r join lines l on l.venue_id = r.venue_id group by all) d join (select geo_unit_id, count(*) as n from lines group by 1) s on s.geo_unit_id = d.geo_unit_id and s.n = d.n'),
    "panel_wide_levels": q(
        "select g.level, g.geo_id, coalesce(p.people, 0) as people, p.mean_age, " + ", ".join(f"coalesce(any_value(p.\"age:{b}\"), 0) as \"age:{b}\"" for _, b in AGE_BANDS) + ", "
        + ", ".join(f"coalesce(sum(value) filter (where family = '{f}' and key = '{k}'), 0)::bigint as \"{f}:{k}\"" for f, k in _WIDE)
        + " from (select distinct level, geo_id from long) g left join long l on l.geo_id = g.geo_id and l.level = g.level left join people p on p.geo_id = g.geo_id and p.level = g.level group by g.level, g.geo_id, p.people, p.mean_age", _PEOPLE + _LONG),
    "records_json": q("""select '{"venue_id":' || venue_id || ',"type":"' || label || '","lat":' || coalesce(lat::double::varchar, 'null') || '}' as record from venues join types on code = type_code"""),
    "lines_geojson": q(
        """select c.line_id, '{"type":"Feature","properties":{"line_id":"' || c.line_id || '","venue_id":' || c.venue_id || ',"mode":"' || mode || '","rider_count":' || rider_count || ',"stops":[' || names || ']},"geometry":{"type":"LineString","coordinates":[' || places || ']}}' as feature
        from counted c join (select line_id, string_agg('"stop ' || node || '"', ',' order by position) as names, string_agg('[' || lon::varchar || ',' || lat::varchar || ']', ',' order by position) as places from exact group by 1) e on e.line_id = c.line_id""", _COUNTED_STOPS),
    "line_tiles": q(f"select line_id, venue_id, z, x, y, part, '[' || arg_min({_POINT('t0')}, n) || ',' || string_agg({_POINT('t1')}, ',' order by n) || ']' as points from numbered group by all", _LINE_TILES),
    "tile_rings": q(f"select z, x, y, layer, q, r, {_RINGS} as ring from tiles", FINEST + TILES),
    "tile_corners": q(f"select z, x, y, round(x / pow(2.0, z) * 360 - 180, 6) as west, round({_lat_of('y + 1')}, 6) as south, round((x + 1) / pow(2.0, z) * 360 - 180, 6) as east, round({_lat_of('y')}, 6) as north from {_ALL_TILES}", FINEST + TILES),
    "tile_bounds": q("select round(minx, 4) as minx, round(miny, 4) as miny, round(maxx, 4) as maxx, round(maxy, 4) as maxy, round((minx + maxx) / 2, 4) as cx, round((miny + maxy) / 2, 4) as cy from (select min(lon)::double as minx, min(lat)::double as miny, max(lon)::double as maxx, max(lat)::double as maxy from points)", FINEST),
    "replicate_unit_places": q(f"select geo_id + rep * units as geo_id, {_PLACES} from geo_units, rep, box", _K + _MOVES),
    "replicate_venue_places": q(f"select venue_id + rep * places as venue_id, {_PLACES} from venues, rep, box", _K + _MOVES),
    "replicate_activities": q("select person_id + rep * people as person_id, geo_unit_id + rep * units as geo_unit_id, activity_idx, venue_id + rep * places as venue_id from activities, rep", REPLICAS),
    "replicate_members": q("select venue_id + rep * places as venue_id, geo_unit_id + rep * units as geo_unit_id, subset_index, person_id + rep * people as person_id from members, rep", REPLICAS),
    "replicate_relations": q("select person_id + rep * people as person_id, (pos - 1)::integer as pos, person_id + pos + rep * people as friend from population, rep, (select unnest([1, 2]) as pos) where person_id % 4 <> 0", REPLICAS),
    "csr_slices": q("select venue_id, subset_index, (n - 2)::integer as pos, person_id from (select *, row_number() over (partition by venue_id, subset_index order by person_id) as n from members) where n > 1"),
    "relabel_lists": q("select person_id, case mktsegment when 'AUTOMOBILE' then 'Cars' else mktsegment end || '|' || case balance_band when 'low' then 'Poor' else balance_band end as labels from population"),
    "venue_properties": q("select venue_id, label as type, case when label = 'company' and rank_in_type % 3 <> 0 then 'v' || rank_in_type % 4 end as company_kind, case when label = 'household' and rank_in_type % 3 <> 0 then 'v' || rank_in_type % 4 end as household_size from venues join types on code = type_code"),
    "rider_legs_typed": q("select person_id, leg_idx, line_id, t_board_min::bigint as t_board_min, t_alight_min::bigint as t_alight_min, value from chains"),
    "units_rows": q("select person_id, geo_unit_id from population where geo_unit_id % 3 = 1"),
    "odd_people_view": q(f"select person_id, case when isnan(age) then -999 else age::double end as age, case sex_code when 5 then '5' else ({SEX.removesuffix(' as sex')}) end as sex, mktsegment from odd_population", _ODD),
    "odd_panel_people": q("select c.level, c.ancestor_id as geo_id, count(*) as people, round(sum(case when isnan(age) then 0 else age::double end) / count(*), 2) as mean_age, " + ", ".join(f"count(*) filter (where band = '{b}') as \"age:{b}\"" for _, b in AGE_BANDS) + " from banded b join closure c on c.geo_id = b.geo_unit_id group by 1, 2", _ODD_PEOPLE),
    "odd_panel_counts": q("select * from long where family in ('sex', 'p')", _ODD_LONG),
    "odd_panel_venues": q("select * from long where family in ('venues', 'occ')", _ODD_LONG),
    "odd_members_view": q("select venue_id, subset_index, case when venue_id % 2 = 0 then 'own' else subset end as subset, m.person_id, coalesce(p.geo_unit_id, -1) as home_geo_unit from members m left join odd_population p on p.person_id = m.person_id", _ODD),
    "odd_activities_view": q(
        f"""select a.person_id, case when a.venue_id % 3 = 0 then '77' else a.activity end as activity, {_VENUE_OF} as venue_id, coalesce(v.unit, -1) as venue_geo_unit,
        coalesce(t.label, v.code::varchar, '') as venue_type, case when v.venue_id is null then '' else coalesce(v.name, v.venue_id::varchar) end as venue_name
        from activities a left join odd_index v on v.venue_id = {_VENUE_OF} left join types t on t.code = v.code""", _ODD),
    "odd_line_geometry": q(
        """select line_id, position, node, lon, round(case when position = 0 then lat + 1 else lat end, 6) as lat from (
          select *, count(*) over (partition by line_id) as n from stops where venue_id % 7 <> 0 and not (position = 1 and venue_id % 4 = 2) and not (position > 0 and venue_id % 12 = 3)) where n >= 2"""),
    "cell_texts": """select o_orderkey, case when k % 5 = 0 then '—' when k % 5 = 1 or o_totalprice = floor(o_totalprice) then format('{:,}', floor(o_totalprice)::bigint) else regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '') end as price,
      case when k % 3 = 2 then o_orderpriority else '—' end as word, case when k % 4 = 0 then '—' else (k % 7) || ', ' || case when k % 2 = 0 then '' else '1' end end as items,
      (case when k % 6 < 3 then 0 else o_custkey end)::double as number, case when k % 6 = 0 then -1 when k % 6 < 3 then 0 else o_custkey end as id from (select *, o_orderkey as k from orders)""",
}

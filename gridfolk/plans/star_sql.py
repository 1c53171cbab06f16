"""SQL for DuckDB that gives the rows of the registered queries, over the same star-schema tables."""

from __future__ import annotations

import math

from ..functions.codes import AGE_BANDS
from ..functions.hexgrid import RESOLUTIONS, ROOT3, edge
from ..functions.mercator import EXTENT, ZOOM_OF

SEGMENTS = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"
BASE = f"""
seg as (select unnest(range(0, 5)) as seg, unnest({SEGMENTS}) as segment),
nat as (select n_nationkey::bigint as k, n_name, n_regionkey::bigint as region, 40 + 0.5::double * (n_nationkey % 5) as lat, -3 + 0.5::double * (n_nationkey // 5) as lon from nation),
geo_units as (
  select r_regionkey::bigint as geo_id, 0 as level, -1::bigint as parent_id, r_name as name, 40.0::float + r_regionkey as lat, -3.0::float as lon from region
  union all select 100 + k, 1, region, n_name, lat::float, lon::float from nat
  union all select 1000 + k * 10 + seg, 2, 100 + k, n_name || '/' || segment, (lat + 0.05::double * seg)::float, (lon + 0.05::double * seg)::float from nat, seg),
population as (
  select c_custkey as person_id, 1000 + c_nationkey * 10 + seg as geo_unit_id, ((c_custkey * 7) % 100)::float as age, (c_custkey % 2)::integer as sex_code, c_mktsegment as mktsegment,
    case when c_acctbal < 0 then 'low' when c_acctbal < 5000 then 'mid' else 'high' end as balance_band
  from customer join seg on segment = c_mktsegment),
types as (select unnest([0, 1, 2, 3]) as code, unnest(['household', 'company', 'train_line', 'tube_line']) as label),
venues as (
  select s_suppkey as venue_id, 100 + s_nationkey::bigint as geo_unit_id, (s_suppkey % 4)::integer as type_code, s_name as name, -1::bigint as parent_id, s_suppkey % 4 = 0 as is_residence,
    case when s_suppkey % 3 <> 0 then lat::float end as lat, case when s_suppkey % 3 <> 0 then lon::float end as lon, row_number() over (partition by s_suppkey % 4 order by s_suppkey) - 1 as rank_in_type
  from supplier join nat on k = s_nationkey),
sold as (select l_suppkey as venue_id, l_returnflag, o_custkey as person_id, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey),
members as (select distinct s.venue_id, v.geo_unit_id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as subset_index, l_returnflag as subset, s.person_id from sold s join venues v on v.venue_id = s.venue_id),
activities as (select distinct s.person_id, p.geo_unit_id, substr(o_orderpriority, 1, 1)::integer - 1 as activity_idx, o_orderpriority as activity, s.venue_id from sold s join population p on p.person_id = s.person_id),
legs as (
  select user_id as person_id, event_id % (select count(*) from supplier) as venue_id, (hour(ts) * 60 + minute(ts))::double as t_board_min, (hour(ts) * 60 + minute(ts) + 1 + event_id % 30)::double as t_alight_min, value, event_id as row_pos
  from events),
closure as (
  select geo_id, level, geo_id as ancestor_id from geo_units
  union all select c.geo_id, p.level, p.geo_id from geo_units c join geo_units p on p.geo_id = c.parent_id
  union all select c.geo_id, g.level, g.geo_id from geo_units c join geo_units p on p.geo_id = c.parent_id join geo_units g on g.geo_id = p.parent_id),
lines as (select v.venue_id, v.name as line_id, replace(t.label, '_line', '') as mode, v.geo_unit_id from venues v join types t on t.code = v.type_code where v.type_code >= 2),
riders as (select m.venue_id, m.person_id, coalesce(p.geo_unit_id, -1) as home_geo_unit from members m join lines l on l.venue_id = m.venue_id left join population p on p.person_id = m.person_id),
counted as (select l.*, coalesce(n, 0) as rider_count from lines l left join (select venue_id, count(*) as n from riders group by 1) r on r.venue_id = l.venue_id),
stops as (
  select s_name as line_id, s_suppkey as venue_id, p.position, n.n_name || '/' || {SEGMENTS}[p.position + 1] as node, round(n.lon + 0.05::double * p.position, 6) as lon, round(n.lat + 0.05::double * p.position, 6) as lat
  from supplier cross join (select unnest(range(0, 4)) as position) p join nat n on n.k = (s_suppkey + p.position) % 25 where s_suppkey % 4 >= 2),
chains as (
  select g.person_id, (row_number() over (partition by g.person_id order by t_board_min, row_pos) - 1)::integer as leg_idx, g.venue_id, l.line_id, l.mode, g.t_board_min, g.t_alight_min, g.value, coalesce(p.geo_unit_id, -1) as home_geo_unit
  from legs g join lines l on l.venue_id = g.venue_id left join population p on p.person_id = g.person_id),
steps as (select person_id, 0 as i, any_value(home_geo_unit) as unit from chains group by 1 union all select c.person_id, leg_idx + 1, l.geo_unit_id from chains c join lines l on l.venue_id = c.venue_id),
known as (select *, lag(unit) over (partition by person_id order by i) as last from steps where unit >= 0),
path as (select person_id, i, unit from known where last is null or last <> unit),
features as (select k, 100 + k as geo_id, lon, lat from nat where k % 7 <> 6),
extents as (select geo_id, round(lon, 6) as cx, round(lat, 6) as cy, round(lon - 0.2, 6) as minx, round(lat - 0.2, 6) as miny, round(lon + 0.2, 6) as maxx, round(lat + 0.2, 6) as maxy from features)
"""


def q(body: str, extra: str = "") -> str:
    return f"with {BASE}{extra}\n{body}"


_BANDS = [label for _, label in AGE_BANDS]
_CASES = " ".join(f"when age < {top} then '{label}'" for top, label in AGE_BANDS[:-1])
_PEOPLE = f""",
banded as (select *, case {_CASES} else '{_BANDS[-1]}' end as band from population),
people as (select c.level, c.ancestor_id as geo_id, count(*) as people, round(sum(age::double) / count(*), 2) as mean_age, {", ".join(f"count(*) filter (where band = '{b}') as \"age:{b}\"" for b in _BANDS)}
  from banded b join closure c on c.geo_id = b.geo_unit_id group by 1, 2)"""
_LONG = """,
leaf as (
  select geo_unit_id, 'sex' as family, case sex_code when 0 then 'male' else 'female' end as key, count(*) as value from population group by all
  union all select geo_unit_id, 'p', 'mktsegment=' || mktsegment, count(*) from population group by all
  union all select geo_unit_id, 'p', 'balance_band=' || balance_band, count(*) from population group by all
  union all select geo_unit_id, 'venues', label, count(*) from venues join types on code = type_code group by all
  union all select m.geo_unit_id, 'occ', label, count(*) from members m join venues v on v.venue_id = m.venue_id join types on code = type_code group by all),
long as (select c.level, c.ancestor_id as geo_id, family, key, sum(value)::bigint as value from leaf join closure c on c.geo_id = geo_unit_id group by all)"""


def _long(family: str) -> str:
    return q(f"select * from long where family = '{family}'", _LONG)


def plane(lat: str, lon: str) -> tuple[str, str]:
    s = f"greatest(-0.9999, least(0.9999, sin(radians({lat}))))"
    return f"(({lon} + 180.0) / 360.0)", f"(0.5 - ln((1 + {s}) / (1 - {s})) / {4 * math.pi!r})"


def _rounded(fq: str, fr: str) -> str:
    """Columns q and r of the hexagon of fractional axial coordinates."""
    rq, rr, rs = f"round_even({fq}, 0)", f"round_even({fr}, 0)", f"round_even(-{fq} - {fr}, 0)"
    dq, dr, ds = f"abs({rq} - {fq})", f"abs({rr} - {fr})", f"abs({rs} + {fq} + {fr})"
    first = f"({dq} > {dr} and {dq} > {ds})"
    return f"(case when {first} then -{rr} - {rs} else {rq} end)::bigint as q, (case when not {first} and {dr} > {ds} then -{rq} - {rs} else {rr} end)::bigint as r"


def _cell(x: str, y: str, res: int) -> str:
    size = edge(res)
    return _rounded(f"(({ROOT3 / 3!r} * {x} - {y} / 3) / {size!r})", f"((2.0 / 3 * {y}) / {size!r})")


def _parent(coarser: int) -> str:
    times = f"{7 ** ((RESOLUTIONS[-1] - coarser) // 2)}::double"
    return _rounded(f"(q / {times})", f"(r / {times})")


def centre(res: int) -> tuple[str, str]:
    size = edge(res)
    return f"({size!r} * ({ROOT3!r} * q + {ROOT3 / 2!r} * r))", f"({size * 1.5!r} * r)"


_X, _Y = plane("lat::double", "lon::double")
FINEST = f""",
points as (
  select 'people' as layer, g.lat, g.lon, count(*) as weight from population p join geo_units g on g.geo_id = p.geo_unit_id group by all
  union all select 'venues', coalesce(v.lat, g.lat), coalesce(v.lon, g.lon), 1 from venues v left join geo_units g on g.geo_id = v.geo_unit_id),
flat as (select layer, {_X} as x, {_Y} as y, weight from points),
finest as (select layer, q, r, sum(weight)::bigint as count from (select layer, weight, {_cell("x", "y", RESOLUTIONS[-1])} from flat) group by all),
pyramid as (
  select layer, {RESOLUTIONS[-1]} as res, q, r, count from finest
  {" ".join(f"union all select layer, {res}, q, r, sum(count)::bigint from (select layer, count, {_parent(res)} from finest) group by all" for res in RESOLUTIONS[:-1])})"""
TILES = f""",
tiles as ({" union all ".join(f"select {ZOOM_OF[res]} as z, floor({centre(res)[0]} * {2 ** ZOOM_OF[res]})::bigint as x, floor({centre(res)[1]} * {2 ** ZOOM_OF[res]})::bigint as y, layer, res, q, r, count from pyramid where res = {res}" for res in RESOLUTIONS)})"""
HILBERT = """,
recursive_tiles as (select distinct z, x, y from tiles),
turns as (
  select z, x, y, z::integer as k, x as tx, y as ty, ((pow(4, z)::bigint - 1) // 3)::bigint as d from recursive_tiles
  union all
  select z, x, y, k - 1,
    case when hy = 0 then (case when hx = 1 then s - 1 - ty else ty end) else tx end,
    case when hy = 0 then (case when hx = 1 then s - 1 - tx else tx end) else ty end,
    d + s * s * xor(3 * hx, hy)
  from (select *, (1::bigint << (k - 1)) as s, ((tx >> (k - 1)) & 1)::bigint as hx, ((ty >> (k - 1)) & 1)::bigint as hy from turns where k > 0))"""


def _tile_y(lat: str, z: str) -> str:
    return f"floor({plane(lat, '0.0')[1]} * pow(2, {z}) * {EXTENT} / {EXTENT})::bigint"


_COVER = """,
spans as (select geo_id, z, greatest(0, floor((minx + 180) / 360 * pow(2, z)))::bigint as x0, least(pow(2, z) - 1, floor((maxx + 180) / 360 * pow(2, z)))::bigint as x1, {top} as y0, {bottom} as y1 from extents cross join (select {z} as z)),
cover as (select geo_id, z, x, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from spans))"""


def _cover(z: int) -> str:
    return _COVER.format(z=z, top=_tile_y("maxy", "z"), bottom=_tile_y("miny", "z"))


REPLICAS = """,
facts as (select greatest(1, ceil((2.0 * n + 1) / n))::bigint as k, people, places, units from (select count(*) as n, max(person_id) + 1 as people from population), (select max(venue_id) + 1 as places from venues), (select max(geo_id) + 1 as units from geo_units)),
rep as (select unnest(range(0, k)) as rep, people, places, units from facts)"""
_JOURNEY = "select person_id, string_agg(unit::varchar, ',' order by i) as units from path group by 1"
_KEYS = """,
unit_keys as (
  select level, geo_id, name, 0 as s, 'code' as strategy, lower(name) as key from geo_units
  union all select level, geo_id, name, 1, 'name', regexp_replace(lower(name), '[^0-9a-z]+', '', 'g') from geo_units),
feature_values as (select 0 as pp, 'CODE' as prop, upper(n_name) as value from nation where n_nationkey % 7 <> 6 union all select 1, 'LABEL', replace(n_name, '_', ' ') from nation where n_nationkey % 7 <> 6),
feature_keys as (select *, 0 as s, lower(value) as key from feature_values union all select *, 1, regexp_replace(lower(value), '[^0-9a-z]+', '', 'g') from feature_values),
cand as (select level, pp, prop, u.s, strategy, count(*) as matched from unit_keys u join (select distinct pp, prop, s, key from feature_keys) f on f.s = u.s and f.key = u.key group by all),
best as (select * from (select *, row_number() over (partition by level order by matched desc, pp, s) as n from cand) where n = 1)"""
_ACTIVITY = "a.activity, a.venue_id, coalesce(v.geo_unit_id, -1) as venue_geo_unit, coalesce(t.label, '') as venue_type, coalesce(v.name, '') as venue_name from activities a left join venues v on v.venue_id = a.venue_id left join types t on t.code = v.type_code"
SEX = "case sex_code when 0 then 'male' else 'female' end as sex"

ORACLES = {
    "geo_closure": q("select geo_id, level, ancestor_id from closure"),
    "geo_children_by_people": q("select parent_id, g.geo_id, g.level, name, regexp_matches(name, '^[A-Z]\\d{6,}$') or name = g.geo_id::varchar as name_is_id, coalesce(people, 0) as people from geo_units g left join people p on p.geo_id = g.geo_id", _PEOPLE),
    "units_per_level": q("select level, ['region', 'nation', 'segment'][level + 1] as name, count(*) as units from geo_units group by all"),
    "panel_people": q("select * from people", _PEOPLE),
    "panel_age_bands": q("select level * 100000 + geo_id as geo_id, replace(item, 'age:', '') as item, value from (unpivot people on columns('age:.*') into name item value value)", _PEOPLE),
    "panel_sex": _long("sex"), "panel_properties": _long("p"), "panel_venues": _long("venues"), "panel_occupancy": _long("occ"),
    "panel_wide": q(
        "select g.geo_id, coalesce(p.people, 0) as people, p.mean_age, "
        + ", ".join(f"coalesce(sum(value) filter (where family = '{f}' and key = '{k}'), 0)::bigint as \"{f}:{k}\"" for f, k in (("sex", "male"), ("sex", "female"), ("venues", "company"), ("occ", "company"), ("occ", "train_line"), ("p", "balance_band=low")))
        + " from (select distinct level, geo_id from long) g left join long l on l.geo_id = g.geo_id and l.level = g.level left join people p on p.geo_id = g.geo_id and p.level = g.level group by g.geo_id, p.people, p.mean_age", _PEOPLE + _LONG),
    "panel_venue_groups": q("select g.geo_id, 'venues' as kind, t.label as item, coalesce(v.value, 0) as value, coalesce(o.value, 0) as occ from (select distinct level, geo_id from long) g cross join types t left join long v on v.level = g.level and v.geo_id = g.geo_id and v.family = 'venues' and v.key = t.label left join long o on o.level = g.level and o.geo_id = g.geo_id and o.family = 'occ' and o.key = t.label where coalesce(v.value, 0) > 0 or coalesce(o.value, 0) > 0", _LONG),
    "panel_shares": q("select l.level, l.geo_id, family, key, value, round(value::double / coalesce(case when family = 'sex' then nullif(people, 0) end, sum(value) over (partition by l.level, l.geo_id, family, case when family = 'p' then split_part(key, '=', 1) end)), 9) as share from long l left join people p on p.level = l.level and p.geo_id = l.geo_id", _PEOPLE + _LONG),
    "panel_extents": q("select p.geo_id, people, cx, cy, minx, miny, maxx, maxy from people p left join extents e on e.geo_id = p.geo_id", _PEOPLE),
    "property_profile": q("select 'mktsegment' as property, count(distinct mktsegment) as n_distinct, false as has_json, count(distinct mktsegment) <= least(64, greatest(8, least(count(*), 4000) // 4)) as usable from population union all select 'balance_band', count(distinct balance_band), false, count(distinct balance_band) <= least(64, greatest(8, least(count(*), 4000) // 4)) from population"),
    "world_schema": q("select 'region,nation,segment' as geo_levels, 'mktsegment,balance_band' as properties, 't_alight_min,value' as leg_fields, true as has_coordinates, (select count(*) from population) as people"),
    "people_view_json": q(f"select person_id, {SEX}, balance_band, (case when person_id % 3 = 0 then 0 else 2 end)::integer as n_tags, (case when person_id % 3 = 0 then 0 else person_id % 5 + person_id % 7 end)::bigint as tag_sum, 'a' || person_id % 4 as names from population"),
    "people_view": q(f"select person_id, geo_unit_id, age, {SEX}, mktsegment, balance_band from population"),
    "venues_view": q("select venue_id, geo_unit_id, label as type, name, parent_id, is_residence, round(coalesce(lat, -999)::double, 3) as lat, round(coalesce(lon, -999)::double, 3) as lon from venues join types on code = type_code"),
    "members_view": q("select m.venue_id, m.geo_unit_id, subset_index, subset, m.person_id, coalesce(p.geo_unit_id, -1) as home_geo_unit from members m left join population p on p.person_id = m.person_id"),
    "members_without_homes": q("select -1 as home_geo_unit, count(*) as n from members"),
    "activities_view": q(f"select a.person_id, a.geo_unit_id, {_ACTIVITY}"),
    "people_by_ids": q(f"select person_id, geo_unit_id, age, {SEX}, mktsegment, balance_band from population where person_id in (select person_id from activities)"),
    "activities_by_ids": q(f"select a.person_id, {_ACTIVITY}"),
    "venue_member_attributes": q(f"select m.venue_id, subset_index, m.person_id, p.geo_unit_id as home_geo_unit, age, {SEX}, mktsegment, balance_band from members m left join population p on p.person_id = m.person_id"),
    "unit_presence": q("select geo_unit_id, count(*) as rows from activities group by 1"),
    "peak_unit_rows": q("select 'population' as container, max(n) as peak from (select count(*) as n from population group by geo_unit_id) union all select 'venues', max(n) from (select count(*) as n from venues group by geo_unit_id) union all select 'subsets', max(n) from (select count(distinct (venue_id, subset_index)) as n from members group by geo_unit_id) union all select 'activities', max(n) from (select count(*) as n from activities group by geo_unit_id)"),
    "csr_offsets": q("select venue_id, n, venue_id % 4 as kind, coalesce(sum(n) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", sum(n) over (o rows between unbounded preceding and current row)::bigint as block_end from (select venue_id, count(*) as n from members group by 1) window o as (partition by venue_id % 4 order by venue_id)"),
    "csr_expand": q("select venue_id, subset_index, row_number() over (partition by venue_id, subset_index order by person_id) - 1 as pos, person_id as value from members"),
    "match_report": q("select g.level, count(*) as world_units, coalesce(matched, 0) as matched, coalesce(strategy, 'none') as strategy, prop, round(coalesce(matched, 0) / count(*), 9) as rate, case when coalesce(matched, 0) / count(*) >= 0.98 then '✓' when coalesce(matched, 0) / count(*) >= 0.5 then '~' else '✗' end as flag from geo_units g left join best b on b.level = g.level group by g.level, matched, strategy, prop", _KEYS),
    "match_unmatched": q(
        """select level, side, n, value from (select *, row_number() over (partition by level, side order by pos, value) as n from (
          select u.level, 'world' as side, u.name as value, u.geo_id as pos from unit_keys u join best b on b.level = u.level and b.s = u.s where not exists (select 1 from feature_keys f where f.prop = b.prop and f.s = b.s and f.key = u.key)
          union all select g.level, 'world', g.name, g.geo_id from geo_units g where g.level not in (select level from best)
          union all select distinct b.level, 'feature', f.value, 0 from best b join feature_keys f on f.prop = b.prop and f.s = b.s where not exists (select 1 from unit_keys u where u.level = b.level and u.s = b.s and u.key = f.key)
          union all select l.level, 'feature', upper(n_name), n_nationkey from nation, (select distinct level from geo_units where level not in (select level from best)) l where n_nationkey % 7 <> 6)) where n <= 8""", _KEYS),
    "key_collisions": q("select level, count(*) - count(distinct regexp_replace(lower(regexp_extract(name, '^([^_/]+)', 1)), '[^0-9a-z]+', '', 'g')) as collisions from geo_units group by 1"),
    "boundary_extent": q("select * from extents"),
    "boundary_tiles": q("select 1 as level, geo_id, z, x, y from cover", _cover(8)),
    "tile_cover": q("select geo_id, z, x, y from cover", _cover(9)),
    "zoom_bands": q("select level, bake_zoom, case when r = 0 then 0 else bake_zoom end as min_zoom, case when nxt is null then 22 else greatest(bake_zoom, nxt - 1) end as max_zoom from (select *, lead(bake_zoom) over (order by level) as nxt from (select level, r, round_even(3 + 9.0 * r / greatest(1, n - 1), 0)::integer as bake_zoom from (select level, row_number() over (order by level) - 1 as r, count(*) over () as n from (select distinct level from geo_units))))"),
    "density_finest": q("select * from finest", FINEST), "density_pyramid": q("select * from pyramid", FINEST),
    "density_color_stops": q("select layer, res, largest, array_to_string(list_transform(range(0, 6), lambda i: greatest(1, floor(pow(largest, i / 5.0) + 0.5)::bigint)::varchar), ',') as stops from (select layer, res, max(count) as largest from pyramid group by all)", FINEST),
    "tile_assign": q("select * from tiles", FINEST + TILES),
    "tile_features": q("select z, x, y, layer, count(*) as n, sum(count)::bigint as people from tiles group by all", FINEST + TILES),
    "tile_hilbert_index": q("select t.d as tile_id, t.z, t.x, t.y, n.n as n_features from turns t join (select z, x, y, count(*) as n from tiles group by all) n on n.z = t.z and n.x = t.x and n.y = t.y where t.k = 0", FINEST + TILES + HILBERT).replace("with ", "with recursive ", 1),
    "tile_stats": q("select count(distinct (z, x, y)) as tiles, count(*) as features, min(z) as min_zoom, max(z) as max_zoom, count(distinct layer) as layers from tiles", FINEST + TILES),
    "line_venues": q("select * from lines"), "line_geometry": q("select line_id, position, node, lon, lat from stops"),
    "line_rider_counts": q("select * from counted"),
    "lines_in_world": q("select c.line_id, c.venue_id, mode, rider_count, n::integer as n_stops from counted c join (select line_id, count(*) as n from stops group by 1) s on s.line_id = c.line_id"),
    "line_lengths": q(f"select line_id, count(dx) as pieces, round(sum(sqrt(dx * dx + dy * dy)), 6) as length from (select line_id, x - lag(x) over o as dx, y - lag(y) over o as dy from (select line_id, position, {plane('lat', 'lon')[0]} * {EXTENT} as x, {plane('lat', 'lon')[1]} * {EXTENT} as y from stops) window o as (partition by line_id order by position)) group by 1"),
    "top_lines": q("select venue_id, line_id, mode, rider_count from counted order by rider_count desc, venue_id limit 3"),
    "sample_riders": q("select t.venue_id, line_id, rider_count, min(r.person_id) as person_id, arg_min(c.legs, r.person_id) as legs from (select * from counted order by rider_count desc, venue_id limit 3) t join riders r on r.venue_id = t.venue_id join (select person_id, count(*) as legs from chains group by 1 having count(*) >= 2) c on c.person_id = r.person_id group by 1, 2, 3"),
    "shared_riders": q("select person_id from riders where venue_id in (2, 3) group by 1 having count(distinct venue_id) = 2"),
    "rider_legs": q("select * from chains"),
    "rider_leg_minutes": q("select line_id, sum(t_alight_min - t_board_min) as minutes, count(*) as legs from chains group by 1"),
    "journey_units": q(_JOURNEY),
    "journey_points": q("select person_id, step, geo_id, name, case when step = 0 then 'start' when step = n - 1 then 'end' else 'via' end as role from (select person_id, (row_number() over (partition by person_id order by i) - 1)::integer as step, unit as geo_id, name, count(*) over (partition by person_id) as n from path join geo_units g on g.geo_id = unit) where n >= 2"),
    "transit_summary": q("select count(*) as lines, count(*) filter (where mode = 'train') as train, count(*) filter (where mode = 'tube') as tube, (select count(*) from riders) as memberships, (select count(distinct person_id) from chains) as riders_with_chains from lines"),
    "replicate_population": q("select person_id + rep * people as person_id, geo_unit_id + rep * units as geo_unit_id, sex_code, mktsegment from population, rep", REPLICAS),
    "replicate_ranks": q("select venue_id + rep * places as venue_id, geo_unit_id + rep * units as geo_unit_id, type_code, parent_id, rank_in_type + rep * count(*) over (partition by type_code, rep) as rank_in_type from venues, rep", REPLICAS),
    "replicate_units": q("select geo_id + rep * units as geo_id, level, case when parent_id < 0 then parent_id else parent_id + rep * units end as parent_id, lower(name) as name from geo_units, rep", REPLICAS),
    "relabel_codes": q("select person_id, case mktsegment when 'AUTOMOBILE' then 'Cars' else mktsegment end as segment from population"),
    "humanize_tokens": q("select geo_id, array_to_string(list_transform(regexp_extract_all(replace(lower(name), '_', ' '), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') as name, lower(name) as code_key, regexp_replace(lower(name), '[^0-9a-z]+', '', 'g') as name_key from geo_units"),
    "page_riders": q("select venue_id, person_id from (select *, row_number() over (partition by venue_id order by person_id) - 1 as n, (count(*) over (partition by venue_id) - 1) // 80 as last from riders) where n // 80 = least(1, last)"),
    "manifest_summary": q("select 'units' as section, ['region', 'nation', 'segment'][level + 1] as name, count(*) as value from geo_units group by all union all select 'peak', 'population', max(n) from (select count(*) as n from population group by geo_unit_id) union all select 'peak', 'venues', max(n) from (select count(*) as n from venues group by geo_unit_id) union all select 'peak', 'subsets', max(n) from (select count(distinct (venue_id, subset_index)) as n from members group by geo_unit_id) union all select 'peak', 'activities', max(n) from (select count(*) as n from activities group by geo_unit_id)"),
    "json_array_typing": "select source, count(*) as n_rows, count(*) filter (where v like '[%') as n_arrays, coalesce(bool_and(regexp_full_match(v, '\\[(-?[0-9]+(,-?[0-9]+)*)?\\]')) filter (where v like '[%'), false) as all_whole from (select 'props' as source, props as v from events union all select 'made', '[' || user_id % 5 || ',' || event_id % 7 || ']' from events union all select 'mixed', case when event_id % 100 = 0 then '[\"x\"]' when event_id % 3 = 0 then '' else '[' || event_id || ']' end from events) group by 1",
    # printf rounds ties to even; totals are halfway between two texts if twice (four times) the number is odd, and moved away from zero.
    "format_numbers": "select o_custkey, case when t is null or not isfinite(t) then '—' when abs(t) < 1e3 then t::bigint::varchar when abs(v) >= 10 then printf('%.0f', v + case when abs(v * 2 % 2) = 1 then sign(v) * 0.1 else 0 end) || unit else printf('%.1f', v + case when abs(v * 4 % 2) = 1 then sign(v) * 0.01 else 0 end) || unit end as short, printf(case when n / 20 >= 0.1 then '%.0f%%' else '%.1f%%' end, 100.0 * n / 20) as pct, n * 1000 as human from (select *, case when abs(t) >= 1e9 then t / 1e9 when abs(t) >= 1e6 then t / 1e6 else t / 1e3 end as v, case when abs(t) >= 1e9 then 'B' when abs(t) >= 1e6 then 'M' else 'k' end as unit from (select o_custkey, case when count(parts) = count(o_totalprice) then round(sum(parts)::double / 1e6) else round(sum(o_totalprice)) end as t, count(*) as n from (select *, try_cast(floor(o_totalprice * 1e6 + 0.5) as decimal(28, 0)) as parts from orders) group by 1))",
}

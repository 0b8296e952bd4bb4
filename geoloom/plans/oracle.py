"""DuckDB SQL for the geocoding queries: named parts, put together as common table expressions.

Every part is plain brute force over all pairs, so that it checks the grids and indexes of the engine."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, FOLDED, LOWER, PLAIN, UPPER
from .fixtures import FX, TABLES, needs


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"least(1e0, sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2))"
    return f"(12742000e0*atan2(sqrt({h}),sqrt(1-{h})))"


def mx(lon: str) -> str:
    return f"(6378137e0*radians({lon}))"


def my(lat: str) -> str:
    return f"(6378137e0*ln(tan(pi()/4+greatest(-1.48352986419518e0,least(1.48352986419518e0,radians({lat})))/2)))"


def normalized(text: str) -> str:
    for to, letters in FOLDED.items():
        text = f"regexp_replace({text}, '[{letters}]', '{to}', 'g')"
    text = f"translate({text}, '{''.join(PLAIN.values()) + UPPER}', '{''.join(k * len(v) for k, v in PLAIN.items()) + LOWER}')"
    text = f"trim(regexp_replace({text}, '[À-ÿ!-/:-@\\[-`{{{{-~ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))".replace("{{", "{")
    for short, long in ABBREVIATIONS.items():
        text = f"regexp_replace({text}, '{short}\\b', '{long}', 'g')"
    return text


def words(normal: str) -> str:
    return f"list_filter(string_split(coalesce({normal}, ''), ' '), lambda t: t <> '')"


def house_number(raw: str) -> str:
    digits = f"try_cast(nullif(regexp_extract({raw}, '^([0-9]+)', 1), '') as hugeint)"
    return f"cast(case when {digits} <= 65535 then {digits} end as int)"


_GLUED = "b.address||coalesce(b.shop_name,'')||coalesce(b.street,'')||coalesce(cast(b.house_number as varchar),'')"
_Q, _A = f"strlen({normalized('q.text')})", f"strlen({normalized(_GLUED)})"
_DLAT, _DLON = "(b.lat-(q.sw_lat+q.ne_lat)*0.5e0)", "(b.lon-(q.sw_lon+q.ne_lon)*0.5e0)"
RANK = (
    "(case when b.lat between q.sw_lat and q.ne_lat and b.lon between q.sw_lon and q.ne_lon then 200 else 0 end"
    f" + cast(trunc(150e0*(1e0/(1e0+sqrt({_DLAT}*{_DLAT}+{_DLON}*{_DLON})))) as int)"
    f" + case when {_A} > 0 then cast(trunc(200e0*least({_Q}/cast({_A} as double), 1e0)) as int) else 0 end)"
)
LABEL = "b.address||coalesce(b.shop_name||', ','')||coalesce(b.street,'')"


def hits(points: str) -> str:
    return f"""
select distinct point_id, level, area_id, name from (
  select p.point_id, a.level, a.area_id, a.name, e.ring from (select point_id, {mx('lon')} px, {my('lat')} py from {points}) p
  join {{box}} a on p.px between a.bl_x and a.tr_x and p.py between a.bl_y and a.tr_y
  join {{edges}} e on e.level = a.level and e.area_id = a.area_id
  where p.py >= e.y_min and p.py < e.y_max and p.px < e.x_at_y_min + (p.py - e.y_min) * e.inv_slope
  group by all having count(*) % 2 = 1)"""


def all_tokens(hits_: str, wanted: str) -> str:
    return f"""
select h.query_id, h.building_id from (select query_id, building_id, count(distinct token) got from {hits_} group by all) h
join (select query_id, count(distinct token) need from {wanted} group by all) w on w.query_id = h.query_id and got = need"""


def centred(frames: str) -> str:
    """Frames (id, x0, y0, x1, y1) and the areas whose centre is in the widened frame."""
    return f"""
select f.*, a.level, a.area_id, a.name from {frames} f join {{box}} a on true join {{extents}} x on x.level = a.level
where a.center_x between f.x0 - x.max_hw and f.x1 + x.max_hw and a.center_y between f.y0 - x.max_hh and f.y1 + x.max_hh"""


LIB = {t: "" for t in TABLES} | FX | {
    "raw": f"select building_id, lat, lon, street, {house_number('house_number_raw')} house_number, shop_name from {{fx_buildings}}",
    "merc": f"select *, {mx('lon')} mx, {my('lat')} my from {{fx_area_vertices}}",
    "box": """
select *, 0.5e0*(bl_x+tr_x) center_x, 0.5e0*(bl_y+tr_y) center_y from (
 select level, area_id, name, min(mx) bl_x, min(my) bl_y, max(mx) tr_x, max(my) tr_y
 from (select *, count(*) over (partition by level, area_id, ring) n from {merc}) where n >= 3 group by all)""",
    "extents": "select level, max((tr_x-bl_x)/2) max_hw, max((tr_y-bl_y)/2) max_hh from {box} group by level",
    "edges": """
select level, area_id, ring, least(my, ny) y_min, greatest(my, ny) y_max, case when my < ny then mx else nx end x_at_y_min, (nx-mx)/nullif(ny-my, 0) inv_slope
from (select *, coalesce(lead(mx) over w, first_value(mx) over w) nx, coalesce(lead(my) over w, first_value(my) over w) ny
      from {merc} window w as (partition by level, area_id, ring order by pos rows between unbounded preceding and unbounded following)) where my <> ny""",
    "bpoints": "select building_id point_id, lat, lon from {raw}",
    "bhits": hits("{bpoints}"),
    "assigned": "select point_id, level, min(area_id) area_id, arg_min(name, area_id) as name from {bhits} group by point_id, level",
    "addresses": "select point_id building_id, string_agg(name||', ', '' order by level) address from {assigned} group by 1",
    "nearest_vertex": """
select building_id, arg_min(name, (d2, street_id)) nearest from (
 select b.building_id, s.street_id, s.name, (s.lat-b.lat)*(s.lat-b.lat)+(s.lon-b.lon)*(s.lon-b.lon) d2 from {raw} b cross join {fx_street_points} s where b.street is null) group by 1""",
    "buildings": """
select b.building_id, b.lat, b.lon, coalesce(b.street, n.nearest) street, b.house_number, b.shop_name, coalesce(a.address, '') address
from {raw} b left join {addresses} a using (building_id) left join {nearest_vertex} n using (building_id)""",
    "postings": f"""
select distinct unnest({words(normalized('f'))}) token, building_id
from (select building_id, unnest([address, shop_name, street, cast(house_number as varchar)]) f from {{buildings}})""",
    "qwords": f"select query_id, {words(normalized('text'))} ws from {{fx_queries}}",
    "parsed": """
select query_id, case when bad then [] when cl then case when pos = 0 then list_slice(ws, 2, 0) else list_slice(ws, 2, pos - 1) end else ws end from_tokens, case when bad or not cl then [] else list_slice(ws, pos + 1, len(ws)) end to_tokens
from (select *, cl and pos <= 2 bad from (select query_id, ws, coalesce(ws[1] = 'closest', false) cl, coalesce(list_position(ws, 'to'), 0) pos from {qwords}))""",
    "qtokens": "select distinct query_id, unnest(ws) token from {qwords}",
    "exact_hits": "select q.query_id, q.token, p.building_id from {qtokens} q join {postings} p on p.token = q.token",
    "exact": all_tokens("{exact_hits}", "{qtokens}"),
    "sides": "select query_id, 'from' side, unnest(from_tokens) token from {parsed} union select query_id, 'to', unnest(to_tokens) from {parsed}",
    "sides_key": "select query_id||'/'||side query_id, token from {sides}",
    "side_hits": "select distinct q.query_id, q.token, p.building_id from {sides_key} q join {postings} p on contains(p.token, q.token)",
    "side_found": all_tokens("{side_hits}", "{sides_key}"),
    "two_sided": "select cast(split_part(query_id, '/', 1) as bigint) query_id, split_part(query_id, '/', 2) side, building_id from {side_found}",
    "substring_all": "select query_id, building_id from {two_sided} where side = 'from'",
    "ranked_sides": f"select s.query_id, s.side, b.building_id, {RANK} \"rank\", {LABEL} label, b.house_number, b.lat, b.lon from {{two_sided}} s join {{fx_queries}} q on q.query_id = s.query_id join {{buildings}} b on b.building_id = s.building_id",
    "anchors": "select * from (select *, row_number() over (partition by query_id order by \"rank\" desc, building_id) i from {ranked_sides} where side = 'to') where i = 1",
    "closest": f"""
select query_id, building_id from (select f.query_id, f.building_id, row_number() over (partition by f.query_id order by {haversine('f.lat', 'f.lon', 'a.lat', 'a.lon')}, f.building_id) i
 from {{ranked_sides}} f join {{anchors}} a on a.query_id = f.query_id where f.side = 'from') where i = 1""",
    "substring": """
select r.query_id, r.building_id, case when c.building_id is null then r."rank" else 0 end "rank", r.label, r.house_number, r.lat, r.lon
from {ranked_sides} r left join {closest} c on c.query_id = r.query_id where r.side = 'from' and (c.building_id is null or c.building_id = r.building_id)""",
    "inverted": f"select q.query_id, b.building_id, {RANK} \"rank\", {LABEL} label, b.house_number, b.lat, b.lon from {{exact}} s join {{fx_queries}} q on q.query_id = s.query_id join {{buildings}} b on b.building_id = s.building_id",
    "near_building": f"""
select p.point_id, b.building_id, round({haversine('p.lat', 'p.lon', 'b.lat', 'b.lon')}, 3) distance from {{fx_points}} p
join (select p.point_id, arg_min(b.building_id, ((b.lat-p.lat)*(b.lat-p.lat)+(b.lon-p.lon)*(b.lon-p.lon), b.building_id)) building_id from {{fx_points}} p cross join {{raw}} b group by 1) n on n.point_id = p.point_id
join {{raw}} b on b.building_id = n.building_id""",
    "near_street": f"""
select p.point_id, n.street_id, s.name, round(min({haversine('p.lat', 'p.lon', 's.lat', 's.lon')}), 3) distance from {{fx_points}} p
join (select p.point_id, arg_min(s.street_id, ((s.lat-p.lat)*(s.lat-p.lat)+(s.lon-p.lon)*(s.lon-p.lon), s.street_id)) street_id from {{fx_points}} p cross join {{fx_street_points}} s group by 1) n on n.point_id = p.point_id
join {{fx_street_points}} s on s.street_id = n.street_id group by 1, 2, 3""",
    "asked_points": f"""
select point_id, lat, lon, case when point_id%4=0 then 1 else 0 end "filter", case point_id%3 when 0 then 4 when 1 then 6 else 8 end expected_level, {mx('lon')} x0, {my('lat')} y0, {mx('lon')} x1, {my('lat')} y1
from (select point_id, lat + case when point_id%10=0 then 0.3e0 else 0e0 end lat, lon from {{fx_points}})""",
    "ask_hits": hits("{asked_points}"),
    "area_inside": "select h.point_id, max(h.level) level, arg_min(h.area_id, (-h.level, h.area_id)) area_id, 0e0 distance from {ask_hits} h join {asked_points} p on p.point_id = h.point_id where p.\"filter\" = 0 or h.level = p.expected_level group by 1",
    "area_near": centred("(select * from {asked_points} where point_id not in (select point_id from {area_inside}))"),
    "near_area": f"""
select point_id, level, area_id, distance from {{area_inside}} union all
select point_id, level, area_id, distance from (select *, row_number() over (partition by point_id order by distance, -level, area_id) i from (
 select c.point_id, c.level, c.area_id, round(min({haversine('c.lat', 'c.lon', 'v.lat', 'v.lon')}), 3) distance from {{area_near}} c
 join {{fx_area_vertices}} v on v.level = c.level and v.area_id = c.area_id where c."filter" = 0 or c.level = c.expected_level group by 1, 2, 3)) where i = 1""",
    "frames": f"select view_id, {mx('sw_lon')} x0, {my('sw_lat')} y0, {mx('ne_lon')} x1, {my('ne_lat')} y1 from {{fx_views}}",
    "view_areas": centred("{frames}"),
}


def oracle(body: str) -> str:
    """body with all the parts that it names, before it."""
    parts: dict[str, str] = {}

    def add(sql: str) -> None:
        for name in needs(sql):
            if name not in parts and LIB.get(name):
                add(LIB[name])
                parts[name] = LIB[name]

    add(body)
    ctes = ", ".join(f'"{k}" as ({_named(v)})' for k, v in parts.items())
    return (f"with {ctes} " if ctes else "") + _named(body)


def _named(sql: str) -> str:
    for name in needs(sql):
        sql = sql.replace("{" + name + "}", f'"{name}"')
    return sql

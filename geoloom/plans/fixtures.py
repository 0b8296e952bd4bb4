"""Deterministic map data derived from the driver's tables, in SQL text that Spark and DuckDB both run.

{name} stands for a table or an earlier fixture."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_NAMES = "(values (0,'Bahnhofstraße'),(1,'Hauptstr.'),(2,'Müller-Pl.'),(3,'Königsallee'),(4,'Oxford Rd'),(5,'Fifth Ave.'),(6,'Universitätsstraße')) v(i,nm)"
TABLES = "region nation customer supplier part orders lineitem events".split()

FX = {
    "fx_buildings": f"""
select c.c_custkey building_id, 48e0+((c.c_custkey*7919)%10007)/10007e0 lat, 9e0+((c.c_custkey*104729)%10009)/10009e0 lon,
 case when c.c_custkey%3=0 then null else v.nm end street,
 case c.c_custkey%6 when 0 then null when 1 then cast(c.c_custkey%90+1 as string)||'a' when 2 then cast(c.c_custkey%90+1 as string)
  when 3 then cast(c.c_custkey%90+1 as string)||'-'||cast(c.c_custkey%90+3 as string) when 4 then ' '||cast(c.c_custkey%90+1 as string) else '70000' end house_number_raw,
 case when c.c_custkey%20=0 then 'REWE' when c.c_custkey%4=0 then c.c_mktsegment else null end shop_name
from {{customer}} c join {_NAMES} on c.c_custkey%7=v.i""",
    "fx_street_points": f"""
select s.s_suppkey street_id, v.nm||' '||cast(s.s_suppkey as string) name, p.pos pos,
 48e0+((s.s_suppkey*3571)%9973)/9973e0+p.pos*0.002e0 lat, 9e0+((s.s_suppkey*15485863)%9967)/9967e0+p.pos*0.001e0*(1-2*(s.s_suppkey%2)) lon
from {{supplier}} s join {_NAMES} on s.s_suppkey%7=v.i cross join (values (0),(1),(2),(3),(4)) p(pos)""",
    "fx_area_vertices": """
select 4 level, cast(r.r_regionkey as bigint) area_id, r.r_name name, 0 ring, v.i pos, 48e0+r.r_regionkey*0.2e0+v.dy lat, 9e0+v.dx lon
from {region} r cross join (values (0,0e0,0e0),(1,0e0,1e0),(2,0.2e0,1e0),(3,0.2e0,0e0)) v(i,dy,dx)
union all select 6, cast(n.n_nationkey as bigint), n.n_name, 0, v.i, 48e0+floor(n.n_nationkey/5e0)*0.2e0+v.dy, 9e0+(n.n_nationkey%5)*0.2e0+v.dx
from {nation} n cross join (values (0,0e0,0e0),(1,0e0,0.19e0),(2,0.19e0,0.19e0),(3,0.19e0,0.1e0),(4,0.1e0,0.1e0),(5,0.1e0,0e0)) v(i,dy,dx)
union all select 8, s.s_suppkey, s.s_name, v.r, v.i, 48e0+floor(s.s_suppkey/10e0)*0.1e0+v.dy, 9e0+(s.s_suppkey%10)*0.1e0+v.dx
from {supplier} s cross join (values (0,0,0e0,0e0),(0,1,0e0,0.05e0),(0,2,0.05e0,0e0),(1,0,0.06e0,0.01e0),(1,1,0.14e0,0.01e0),(1,2,0.06e0,0.09e0)) v(r,i,dy,dx) where s.s_suppkey<100""",
    "fx_points": "select event_id point_id, 48e0+((event_id*611953)%10037)/10037e0 lat, 9e0+((event_id*7368787)%10039)/10039e0 lon from {events}",
    "fx_views": "select cast(r_regionkey as bigint) view_id, 48.05e0+r_regionkey*0.15e0 sw_lat, 9.1e0+r_regionkey*0.1e0 sw_lon, 48.25e0+r_regionkey*0.15e0 ne_lat, 9.4e0+r_regionkey*0.1e0 ne_lon from {region}",
    "fx_queries": """
select cast(q.id as bigint) query_id, q.tx text, v.sw_lat, v.sw_lon, v.ne_lat, v.ne_lon
from (values (0,'Bahnhofstrasse 12'),(1,'bahnhof'),(2,'REWE'),(3,'Mueller Platz'),(4,'Closest Rewe to Universitaetsstrasse'),(5,'closest rewe to'),
 (6,'closest to x'),(7,''),(8,'nosuchtoken'),(9,'Stuttgart Bahnhofstrasse 10'),(10,'closest hauptstr to nosuchtoken'),(11,'EUROPE könig'),(12,'closest auto to rewe 61'),
 (13,'strasse 3'),(14,'closest rewe'),(15,'  '),(16,'to rewe')) q(id,tx) join {fx_views} v on v.view_id = q.id % 5""",
    "fx_objects": """
select c_custkey id, case when c_custkey%2=0 then 'no' end building, case when c_custkey%5=0 then c_mktsegment end shop, case when c_custkey%13=0 then 'cafe' end amenity,
 case when c_custkey%7=0 then 'residential' end highway, case when c_custkey%22=0 then 'administrative' when c_custkey%11=0 then 'maritime' end boundary,
 case when c_custkey%3<>0 then c_name end name, case when c_custkey%4=0 then 'DE '||c_name end name_de, case when c_custkey%6=0 then 'Brand' end brand,
 case when c_custkey%12=0 then 'Marke' end brand_de, case when c_custkey%3=1 then 'Hauptstr.' end street, case when c_custkey%9=1 then 'Königsallee' end street_de,
 case c_custkey%6 when 1 then cast(c_custkey%90+1 as string)||'a' when 2 then cast(c_custkey%90+1 as string) when 3 then '007' when 4 then ' 12' when 5 then '70000' end house_number,
 case c_custkey%5 when 0 then '8' when 1 then ' 6' when 2 then '8;9' when 3 then 'x' else '300' end admin_level,
 48e0+((c_custkey*7919)%10007)/10007e0 lat, 9e0+((c_custkey*104729)%10009)/10009e0 lon
from {customer}""",
    "fx_refs": """
select s_suppkey id, p.pos pos, case when p.pos=2 and s_suppkey%5=0 then -s_suppkey when p.pos=4 and s_suppkey%3=0 then (s_suppkey*17)%140+1 else (s_suppkey*17+p.pos*31)%140+1 end ref
from {supplier} cross join (values (0),(1),(2),(3),(4)) p(pos)
union all select 1000000+2*r_regionkey+p.w, p.pos, case when p.w=1 and p.pos=2 then r_regionkey*10+1 else r_regionkey*10+1+p.w*2+p.pos end
from {region} cross join (values (0,0),(0,1),(0,2),(1,0),(1,1),(1,2)) p(w,pos)""",
}


@cache
def needs(sql: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"{(\w+)}", sql)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = {n: fixture(spark, sf_dir, n) if n in FX else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in needs(FX[name])}
    return spark.sql(FX[name], **own)

"""The geocoding queries by name, and the SQL that checks them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G, tags as T, text as X
from ..operators import areas as A, nearest as N, search as S, views as V
from ..sources import osm
from ..sources.snapshot import snapshot_read as read_snapshot, snapshot_write as write_snapshot
from . import oracle as O
from .fixtures import fixture
from .preprocess import interpolate_street, preprocess, saved, with_addresses
from .tables import scratch_path

ROOT = str(Path(__file__).resolve().parents[2])
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (fx), where fx(name) is a fixture, as the query of its name, and its SQL."""

    def add(f):
        name = f.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # Python workers import this package
            return f(lambda n: fixture(spark, sf_dir, n))

        QUERIES[name] = run
        SQL[name] = O.oracle(sql)
        return f

    return add


def raw(fx) -> DataFrame:
    return fx("fx_buildings").withColumn("house_number", X.house_number(F.col("house_number_raw"))).drop("house_number_raw")


_PREPARED: dict[tuple, tuple[str, dict]] = {}


def prepared(fx) -> dict[str, DataFrame]:
    """The tables that preprocessing leaves, from a snapshot: made by the first query of a session over the same input, and
    read by all that follow."""
    source = raw(fx)
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, tuple(sorted(source.inputFiles())))
    if key not in _PREPARED:
        path = scratch_path(spark, "prepared")
        tables = saved(preprocess(source, fx("fx_street_points"), fx("fx_area_vertices")), path)
        _PREPARED[key] = path, {k: v.schema for k, v in tables.items()}
    return read_snapshot(spark, *_PREPARED[key])


def enriched(fx) -> DataFrame:
    return prepared(fx)["buildings"]


def index(fx) -> S.Index:
    tables = prepared(fx)
    return S.Index(tables["postings"], tables["grams"], tables["gram_counts"])


_KEYS = {"building": "building", "shop": "shop", "amenity": "amenity", "highway": "highway", "boundary": "boundary", "name": "name", "name_de": "name:de", "brand": "brand", "brand_de": "brand:de", "street": "addr:street", "street_de": "addr:street:de", "house_number": "addr:housenumber", "admin_level": "admin_level"}


def objects(fx) -> DataFrame:
    pairs = [x for c, k in _KEYS.items() for x in (F.lit(k), F.col(c))]
    return fx("fx_objects").select("id", "lat", "lon", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("tags"))


def nodes(fx) -> DataFrame:
    return fx("fx_points").selectExpr("point_id as id", "lat", "lon", "cast(map() as map<string,string>) as tags")


def ways(fx) -> DataFrame:
    refs = fx("fx_refs").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    kind = "map(if(id % 2 = 0, 'building', 'highway'), 'yes', if(id % 7 = 0, 'ref', 'name'), concat('Way ', id), 'boundary', 'administrative', 'admin_level', '8')"
    return refs.selectExpr("id", "refs", f"{kind} as tags")


def relations(fx) -> DataFrame:
    tags = "map('type', 'boundary', 'boundary', 'administrative', 'name', r_name, 'admin_level', '4')"
    member = "named_struct('type', 'way', 'ref', 1000000L + 2 * r_regionkey + {}, 'role', 'outer')"
    return _regions(fx).selectExpr("cast(r_regionkey as bigint) as id", f"array({member.format(1)}, {member.format(0)}) as members", f"{tags} as tags")


def _regions(fx) -> DataFrame:
    return fx("fx_area_vertices").where("level = 4").selectExpr("area_id as r_regionkey", "name as r_name").distinct()


_VALID = "select r.id, r.pos, n.lat, n.lon from {fx_refs} r join {fx_points} n on n.point_id = r.ref"
O.LIB["located"] = _VALID
O.LIB["shape"] = "select id, count(*) n, arg_min(ref, pos) a, arg_max(ref, pos) z from {fx_refs} group by id"
O.LIB["rings"] = """
select s.id * 2 area_id, l.pos, l.lat, l.lon, 'Way '||s.id as nm, s.id % 2 = 0 building, s.id % 7 = 0 unnamed, 8 level from {shape} s join {located} l on l.id = s.id where s.n > 3 and s.a = s.z
union all select 2 * ((l.id - 1000000) // 2) + 1, l.pos, l.lat, l.lon, r.r_name, false, false, 4 from {located} l join {region} r on r.r_regionkey = (l.id - 1000000) // 2 where l.id >= 1000000 and (l.id % 2 = 0 or l.pos > 0)"""


# sources, predicates and extraction


@query("""
select 'node' kind, point_id id, round(lat, 9) lat, round(lon, 9) lon, 'kind=n'||point_id % 3 tags, cast(null as varchar) refs from {fx_points}
union all select 'way', id, null, null, 'name='||'Way '||id, string_agg(ref, ',' order by pos) from {fx_refs} group by id
union all select 'relation', r_regionkey, null, null, 'name='||r_name, 'way '||(1000001 + 2 * r_regionkey)||' outer,way '||(1000000 + 2 * r_regionkey)||' outer' from {region}""")
def scan_osm(fx):
    """Writes nodes, ways and relations as XML to the shared folder, and scans them."""
    made = nodes(fx)
    spark, path = made.sparkSession, scratch_path(made.sparkSession, "osm")
    tag = lambda k, v: F.array(F.struct(F.lit(k).alias("_k"), v.alias("_v"))).alias("tag")
    own = F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"), m["role"].alias("_role")))
    rows = {
        "node": made.select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tag("kind", F.concat(F.lit("n"), F.col("id") % 3))),
        "way": ways(fx).select(F.col("id").alias("_id"), F.transform("refs", lambda r: F.struct(r.alias("_ref"))).alias("nd"), tag("name", F.concat(F.lit("Way "), F.col("id")))),
        "relation": relations(fx).select(F.col("id").alias("_id"), own.alias("member"), tag("name", F.col("tags")["name"])),
    }
    for kind, df in rows.items():
        df.write.format("xml").option("rootTag", "osm").option("rowTag", kind).save(f"{path}/{kind}")
    node, way, relation = osm.scan_osm(spark, f"{path}/*")
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    member = lambda m: F.concat_ws(" ", m["type"], m["ref"].cast("string"), m["role"])
    none, place = F.lit(None).cast("string"), [F.lit(None).cast("double").alias(c) for c in ("lat", "lon")]
    out = node.select(F.lit("node").alias("kind"), "id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), text("tags").alias("tags"), none.alias("refs"))
    out = out.union(way.select(F.lit("way"), "id", *place, text("tags"), F.array_join("refs", ",")))
    return out.union(relation.select(F.lit("relation"), "id", *place, text("tags"), F.array_join(F.transform("members", member), ",")))


@query("select id, pos, lat, lon from {located}")
def resolve_way_locations(fx):
    return osm.resolve_way_locations(ways(fx), nodes(fx))


@query("select area_id, count(*) n, round(avg(lat), 9) lat, round(avg(lon), 9) lon from {rings} group by 1")
def assemble_areas(fx):
    made = osm.assemble_areas(ways(fx), relations(fx), nodes(fx))
    return made.groupBy("area_id").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))


def _snapshot(fx):
    table = raw(fx)
    path = scratch_path(table.sparkSession, "snapshot")
    write_snapshot({"buildings": table, "areas": fx("fx_area_vertices")}, path)
    return read_snapshot(table.sparkSession, path, {"buildings": table.schema, "areas": fx("fx_area_vertices").schema})


@query("select * from {raw}")
def snapshot_write(fx):
    return _snapshot(fx)["buildings"]


@query("select * from {fx_area_vertices}")
def snapshot_read(fx):
    return _snapshot(fx)["areas"]


@query("select id from {fx_objects} where building is not null or shop is not null or amenity is not null")
def is_building(fx):
    return objects(fx).where(T.is_building(F.col("tags"))).select("id")


@query("select id from {fx_objects} where highway is not null")
def is_street(fx):
    return objects(fx).where(T.is_street(F.col("tags"))).select("id")


@query("select id from {fx_objects} where boundary = 'administrative'")
def is_admin_area(fx):
    return objects(fx).where(T.is_admin_area(F.col("tags"))).select("id")


@query("select id, coalesce(street_de, street) street from {fx_objects}")
def street_name(fx):
    return objects(fx).select("id", T.street_name(F.col("tags")).alias("street"))


@query("select id, coalesce(name_de, name, brand_de, brand) shop_name from {fx_objects}")
def shop_name(fx):
    return objects(fx).select("id", T.shop_name(F.col("tags")).alias("shop_name"))


@query("select id, coalesce(name_de, name) \"name\" from {fx_objects}")
def object_name(fx):
    return objects(fx).select("id", T.object_name(F.col("tags")).alias("name"))


@query("select building_id, house_number from {raw}")
def house_number(fx):
    return raw(fx).select("building_id", "house_number")


@query(f"select id building_id, lat, lon, coalesce(street_de, street) street, {O.house_number('house_number')} house_number, coalesce(name_de, name, brand_de, brand) shop_name from {{fx_objects}} where building is not null or shop is not null or amenity is not null")
def node_building(fx):
    return osm.node_buildings(objects(fx))


@query("select s.id street_id, 'Way '||s.id as name, l.pos, l.lat, l.lon from {shape} s left join {located} l on l.id = s.id where s.id % 2 = 1 and s.id % 7 <> 0")
def way_street(fx):
    return osm.way_streets(ways(fx), nodes(fx))


@query("select area_id building_id, round(avg(lat), 9) lat, round(avg(lon), 9) lon, max(case when not unnamed then nm end) shop_name from {rings} where building group by 1")
def area_building(fx):
    made = osm.area_buildings(osm.assemble_areas(ways(fx), relations(fx), nodes(fx)))
    return made.select("building_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "shop_name")


@query("select level, area_id, nm as name, count(*) n from {rings} where not building and not unnamed group by 1, 2, 3")
def area_admin(fx):
    made = osm.area_admins(osm.assemble_areas(ways(fx), relations(fx), nodes(fx)))
    return made.groupBy("level", "area_id", "name").agg(F.count("*").alias("n"))


@query("select area_id, round(avg(lat), 9) lat, round(avg(lon), 9) lon from {rings} group by 1")
def vertex_centroid(fx):
    made = osm.vertex_centroids(osm.assemble_areas(ways(fx), relations(fx), nodes(fx)))
    return made.select("area_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("select id, coalesce(name_de, name) \"name\" from {fx_objects} where coalesce(name_de, name) is not null")
def drop_unnamed(fx):
    return osm.drop_unnamed(objects(fx).select("id", T.object_name(F.col("tags")).alias("name")))


@query("select 'buildings' kind, count(*) n from {fx_buildings} union all select 'streets', count(distinct street_id) from {fx_street_points} union all select 'admin_areas', count(distinct (level, area_id)) from {fx_area_vertices}")
def count_objects(fx):
    return osm.counts(fx("fx_buildings"), fx("fx_street_points"), fx("fx_area_vertices"))


# scalar geometry

_PAIR = "from {fx_points} p join {raw} b on b.building_id = p.point_id % (select count(*) from {raw}) + 1"


def _c(*names):
    return [F.col(n) for n in names]


def _pairs(fx):
    own = raw(fx).select("building_id", F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return fx("fx_points").join(own, F.col("building_id") == F.col("point_id") % own.count() + 1)


@query(f"select p.point_id, round({O.haversine('p.lat', 'p.lon', 'b.lat', 'b.lon')}, 3) d {_PAIR}")
def haversine(fx):
    return _pairs(fx).select("point_id", F.round(G.haversine(*_c("lat", "lon", "blat", "blon")), 3).alias("d"))


@query(f"select point_id, round({O.mx('lon')}, 3) x, round({O.my('lat')}, 3) y from {{fx_points}}")
def project_mercator(fx):
    return fx("fx_points").select("point_id", F.round(G.mercator_x(F.col("lon")), 3).alias("x"), F.round(G.mercator_y(F.col("lat")), 3).alias("y"))


@query(f"select p.point_id, round(sqrt((b.lat-p.lat)*(b.lat-p.lat)+(b.lon-p.lon)*(b.lon-p.lon)), 9) d {_PAIR}")
def euclidean_distance(fx):
    return _pairs(fx).select("point_id", F.round(G.euclidean(*_c("lat", "lon", "blat", "blon")), 9).alias("d"))


@query(f"select p.point_id, (b.lat-p.lat)*(b.lat-p.lat)+(b.lon-p.lon)*(b.lon-p.lon) d2 {_PAIR}")
def degree_distance2(fx):
    return _pairs(fx).select("point_id", G.degree_distance2(*_c("lat", "lon", "blat", "blon")).alias("d2"))


@query("select level, area_id, round(bl_x, 3) bl_x, round(bl_y, 3) bl_y, round(tr_x, 3) tr_x, round(tr_y, 3) tr_y from {box}")
def bbox(fx):
    return A.boxes(fx("fx_area_vertices")).select("level", "area_id", *(F.round(c, 3).alias(c) for c in ("bl_x", "bl_y", "tr_x", "tr_y")))


@query("select level, area_id, ring, round(y_min, 3) y_min, round(y_max, 3) y_max, round(x_at_y_min, 3) x_at_y_min, round(inv_slope, 6) + 0e0 inv_slope from {edges}")
def ring_edges(fx):
    made = A.ring_edges(fx("fx_area_vertices"))
    return made.select("level", "area_id", "ring", *(F.round(c, 3).alias(c) for c in ("y_min", "y_max", "x_at_y_min")), (F.round("inv_slope", 6) + 0).alias("inv_slope"))


@query("""select e.level, e.area_id, e.ring, round(e.y_min, 3) y_min, cast(unnest(range(greatest(0, least(31, cast(floor((e.y_min-b.bl_y)/((b.tr_y-b.bl_y)/32)) as int))),
 greatest(0, least(31, cast(floor((e.y_max-b.bl_y)/((b.tr_y-b.bl_y)/32)) as int))) + 1)) as int) "bin" from {edges} e join {box} b on b.level = e.level and b.area_id = e.area_id""")
def edge_bins(fx):
    return A.edge_bins(fx("fx_area_vertices")).select("level", "area_id", "ring", F.round("y_min", 3).alias("y_min"), "bin")


@query("select point_id, level, area_id from (" + O.hits("{fx_points}") + ")")
def point_in_polygon(fx):
    return A.containing(fx("fx_points"), fx("fx_area_vertices")).select("point_id", "level", "area_id")


@query("""select p.point_id, v.view_id, round(power(greatest(v.sw_lat-p.lat, 0e0, p.lat-v.ne_lat), 2)+power(greatest(v.sw_lon-p.lon, 0e0, p.lon-v.ne_lon), 2), 12) d2
from {fx_points} p join {fx_views} v on v.view_id = p.point_id % 5""")
def distance_to_box(fx):
    both = fx("fx_points").join(F.broadcast(fx("fx_views")), F.col("view_id") == F.col("point_id") % 5)  # five views
    d2 = G.distance_to_box(*(F.col(c) for c in ("lat", "lon", "sw_lat", "sw_lon", "ne_lat", "ne_lon")))
    return both.select("point_id", "view_id", F.round(d2, 12).alias("d2"))


# indexes and range primitives


@query("select cast(floor(lat/0.25e0) as bigint) cx, cast(floor(lon/0.25e0) as bigint) cy, count(*) n from {raw} group by 1, 2")
def kd_build(fx):
    return N.cells(raw(fx), 0.25).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("select v.view_id, p.point_id from {fx_points} p join {fx_views} v on p.lat between v.sw_lat and v.ne_lat and p.lon between v.sw_lon and v.ne_lon")
def range_search(fx):
    return V.in_views(fx("fx_points"), fx("fx_views")).select("view_id", "point_id")


_NN = "arg_min(s.street_id, ((s.lat-p.lat)*(s.lat-p.lat)+(s.lon-p.lon)*(s.lon-p.lon), s.street_id)) target_id, min((s.lat-p.lat)*(s.lat-p.lat)+(s.lon-p.lon)*(s.lon-p.lon)) d2"


@query(f"select p.point_id, {_NN} from {{fx_points}} p cross join {{fx_street_points}} s group by 1")
def find_nearest(fx):
    return N.find_nearest(fx("fx_points"), fx("fx_street_points").select(F.col("street_id").alias("target_id"), "lat", "lon"))


@query("select building_id from {postings} where token in ('auto', 'europe', 'platz') group by 1 having count(distinct token) = 1 intersect select building_id from {postings} where token = 'europe'")
def sorted_intersect(fx):
    posting = index(fx).postings
    once = posting.where("token in ('auto', 'europe', 'platz')").groupBy("building_id").agg(F.countDistinct("token").alias("n")).where("n = 1")
    return once.select("building_id").intersect(S.get_buildings(posting, "europe"))


@query("select level, round(max_hw, 3) max_hw, round(max_hh, 3) max_hh from {extents}")
def level_extents(fx):
    made = A.level_extents(A.boxes(fx("fx_area_vertices")))
    return made.select("level", F.round("max_hw", 3).alias("max_hw"), F.round("max_hh", 3).alias("max_hh"))


@query("select level, area_id, round(center_x, 3) center_x, round(center_y, 3) center_y from {box}")
def bbox_center(fx):
    return A.boxes(fx("fx_area_vertices")).select("level", "area_id", F.round("center_x", 3).alias("center_x"), F.round("center_y", 3).alias("center_y"))


# enrichment


@query("select point_id, level, area_id, name from {assigned}")
def assign_admin_areas(fx):
    return A.assign_admin_areas(raw(fx).select(F.col("building_id").alias("point_id"), "lat", "lon"), fx("fx_area_vertices"))


@query("select b.building_id, coalesce(a.address, '') address from {raw} b left join {addresses} a using (building_id)")
def build_address(fx):
    return with_addresses(raw(fx), fx("fx_area_vertices")).select("building_id", "address")


@query("select b.building_id, coalesce(b.street, n.nearest) street from {raw} b left join {nearest_vertex} n using (building_id)")
def interpolate_street_(fx):
    return interpolate_street(raw(fx), fx("fx_street_points")).select("building_id", "street")


@query("select s.id street_id, l.pos, l.lat, l.lon from {shape} s join {located} l on l.id = s.id where s.id % 2 = 1 and s.id % 7 <> 0")
def explode_street_points(fx):
    return osm.way_streets(ways(fx), nodes(fx)).where("pos is not null").select("street_id", "pos", "lat", "lon")


@query("select building_id, street, house_number, shop_name, address from {buildings}")
def preprocess_(fx):
    made = preprocess(raw(fx), fx("fx_street_points"), fx("fx_area_vertices"))["buildings"]
    return made.select("building_id", "street", "house_number", "shop_name", "address")


# text


def _documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.normalize_address(F.col("text")).alias("normal"))


QUERIES["normalize_address"] = lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", F.md5(F.coalesce("normal", F.lit("")).cast("binary")).alias("normal"))
SQL["normalize_address"] = f"select doc_id, md5(coalesce({O.normalized('text')}, '')) normal from documents"
QUERIES["tokenize"] = lambda spark, sf_dir: (
    _documents(spark, sf_dir).select(F.explode(X.tokens(F.col("normal"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
)
SQL["tokenize"] = f"select token, count(*) n from (select unnest({O.words(O.normalized('text'))}) token from documents) group by 1"


@query("select token, building_id from {postings}")
def index_building(fx):
    return S.postings(enriched(fx))


@query("select building_id from {postings} where token = 'rewe'")
def get_buildings(fx):
    return S.get_buildings(index(fx).postings, "rewe")


@query("select query_id, building_id from {exact}")
def search_exact_tokens(fx):
    return S.search_exact(fx("fx_queries"), index(fx).postings)


@query("select distinct token, substr(token, i, n) gram from (select distinct token from {postings}) cross join range(1, 80) a(i) cross join range(1, 4) b(n) where i + n - 1 <= length(token)")
def suffix_array_build(fx):
    return S.grams(S.vocabulary(S.postings(enriched(fx))))


@query("select distinct q.query_id, q.token, p.building_id from {qtokens} q join {postings} p on contains(p.token, q.token)")
def search_substring_token(fx):
    wanted = S.query_tokens(fx("fx_queries")).select("query_id", F.explode("words").alias("token")).distinct()
    return S.containing_tokens(wanted, index(fx))


O.LIB["sub_hits"] = "select distinct q.query_id, q.token, p.building_id from {qtokens} q join {postings} p on contains(p.token, q.token)"


@query(O.all_tokens("{sub_hits}", "{qtokens}"))
def search_substring_all(fx):
    return S.search_tokens(S.query_tokens(fx("fx_queries")), index(fx))


@query("select query_id, array_to_string(from_tokens, ' ') from_tokens, array_to_string(to_tokens, ' ') to_tokens from {parsed}")
def parse_closest(fx):
    parsed = S.query_tokens(fx("fx_queries")).select("query_id", X.parse_closest(F.col("words")).alias("p"))
    return parsed.select("query_id", F.array_join("p.from_tokens", " ").alias("from_tokens"), F.array_join("p.to_tokens", " ").alias("to_tokens"))


@query("select query_id, side, building_id from {two_sided}")
def search_two_sided(fx):
    return S.search_two_sided(fx("fx_queries"), index(fx))


@query("select distinct token from {postings}")
def vocabulary(fx):
    return S.vocabulary(S.postings(enriched(fx)))


# ranking and results


@query(f"select q.query_id, b.building_id, {O.RANK} \"rank\" from {{buildings}} b join {{fx_queries}} q on q.query_id = b.building_id % 17")
def rank_buildings(fx):
    both = enriched(fx).join(fx("fx_queries"), F.col("query_id") == F.col("building_id") % 17)
    return both.select("query_id", "building_id", S.rank(F.col("text")).alias("rank"))


@query("select query_id, building_id, \"rank\", label, house_number, lat, lon from {substring}")
def search_suffix(fx):
    return S.search_substring(fx("fx_queries"), enriched(fx), index(fx))


@query("select query_id, building_id, \"rank\", label, house_number, lat, lon from {inverted}")
def search_inverted(fx):
    return S.search_inverted(fx("fx_queries"), enriched(fx), index(fx))


@query("select query_id, building_id from {closest}")
def closest_to(fx):
    buildings, queries = enriched(fx), fx("fx_queries")
    found = S.search_two_sided(queries, index(fx))
    return S.closest_to(S.ranked(found, queries, buildings).join(found, ["query_id", "building_id"]))


@query(f"select b.building_id, {O.LABEL} label from {{buildings}} b")
def display_address(fx):
    return enriched(fx).select("building_id", S.display_address().alias("label"))


@query("select query_id, building_id, \"rank\" from {substring} where query_id % 2 = 0 and query_id not in (7, 15) union all select query_id, building_id, \"rank\" from {inverted} where query_id % 2 = 1 and query_id not in (7, 15)")
def search_dispatch(fx):
    return S.search(fx("fx_queries").withColumn("exact", F.col("query_id") % 2 == 1), enriched(fx), index(fx)).select("query_id", "building_id", "rank")


# viewports


@query("select v.view_id, b.building_id, b.lat, b.lon, b.street is not null has_street, b.house_number is not null has_house_number from {buildings} b join {fx_views} v on b.lat between v.sw_lat and v.ne_lat and b.lon between v.sw_lon and v.ne_lon")
def buildings_in_view(fx):
    return V.buildings_in_view(fx("fx_views"), enriched(fx))


@query("select v.view_id, s.street_id, s.name, s.pos, s.lat, s.lon from (select distinct v.view_id, s.street_id from {fx_street_points} s join {fx_views} v on s.lat between v.sw_lat and v.ne_lat and s.lon between v.sw_lon and v.ne_lon) v join {fx_street_points} s on s.street_id = v.street_id")
def streets_in_view(fx):
    return V.streets_in_view(fx("fx_views"), fx("fx_street_points"))


@query("select view_id, level, area_id, name from {view_areas}")
def admin_areas_in_view(fx):
    return V.admin_areas_in_view(fx("fx_views"), fx("fx_area_vertices"))


_ZOOM = "cast(case " + " ".join(f"when zoom <= {z} then {n}" for z, n in V.ZOOMS.items()) + " end as int)"


def _zooms(fx):
    return fx("fx_points").select("point_id", (F.col("point_id") % 21).cast("int").alias("zoom"))


@query(f"select v.view_id, v.level, v.area_id from {{view_areas}} v, (select *, cast(7 + view_id as int) zoom from {{fx_views}}) z where z.view_id = v.view_id and ({_ZOOM} is null or {_ZOOM} = v.level)")
def areas_for_zoom(fx):
    found = V.admin_areas_in_view(fx("fx_views"), fx("fx_area_vertices"))
    return V.areas_for_zoom(found, (F.col("view_id") + 7).cast("int")).select("view_id", "level", "area_id")


@query(f"select point_id, zoom, {_ZOOM} level from (select point_id, cast(point_id % 21 as int) zoom from {{fx_points}})")
def zoom_to_level(fx):
    return _zooms(fx).select("point_id", "zoom", V.zoom_to_level(F.col("zoom")).cast("int").alias("level"))


@query("select point_id, zoom, zoom >= 15 buildings, zoom >= 13 streets, zoom < 13 areas from (select point_id, cast(point_id % 21 as int) zoom from {fx_points})")
def dynamic_layers(fx):
    return _zooms(fx).select("point_id", "zoom", *V.dynamic_layers(F.col("zoom")))


@query("select building_id, case when street is null then 'grey' when house_number is null then 'green' else 'blue' end class from {raw}")
def marker_class(fx):
    return raw(fx).select("building_id", V.marker_class(F.col("street"), F.col("house_number")).alias("class"))


@query("""select r.query_id, r.building_id, case when trim(r.label||' '||coalesce(cast(r.house_number as varchar), '')) = '' then '(unnamed building)' else trim(r.label||' '||coalesce(cast(r.house_number as varchar), '')) end shown,
 r.lat between q.sw_lat and q.ne_lat and r.lon between q.sw_lon and q.ne_lon in_view from {inverted} r join {fx_queries} q on q.query_id = r.query_id""")
def result_in_view(fx):
    found = S.search_inverted(fx("fx_queries"), enriched(fx), index(fx)).join(fx("fx_queries").drop("text"), "query_id")
    return V.result_in_view(found).select("query_id", "building_id", "shown", "in_view")


# reverse geocoding


@query("select point_id, building_id, distance from {near_building}")
def nearest_building(fx):
    return N.nearest_building(fx("fx_points"), raw(fx)).select("point_id", "building_id", F.round("distance", 3).alias("distance"))


@query("select point_id, street_id, name, distance from {near_street}")
def nearest_street(fx):
    return N.nearest_street(fx("fx_points"), fx("fx_street_points")).withColumn("distance", F.round("distance", 3))


def _asked(fx):
    lat = F.col("lat") + F.when(F.col("point_id") % 10 == 0, 0.3).otherwise(0.0)
    return fx("fx_points").select(
        "point_id", lat.alias("lat"), "lon", F.when(F.col("point_id") % 4 == 0, 1).otherwise(0).alias("filter"),
        F.when(F.col("point_id") % 3 == 0, 4).when(F.col("point_id") % 3 == 1, 6).otherwise(8).alias("expected_level"),
    )


@query("select point_id, level, area_id, distance from {near_area}")
def nearest_admin_area(fx):
    made = N.nearest_admin_area(_asked(fx), fx("fx_area_vertices"))
    return made.select("point_id", "level", "area_id", F.round("distance", 3).alias("distance"))


_KIND = "case when b is not null and s is not null and a is not null then case when b < s then case when a < b then 'area' else 'building' end when a < s then 'area' else 'street' end when b is not null and s is not null then case when b < s then 'building' else 'street' end end"


@query(f"select point_id, {_KIND} kind from (select b.point_id, b.distance b, s.distance s, a.distance a from {{near_building}} b join {{near_street}} s using (point_id) left join {{near_area}} a using (point_id))")
def nearest_object(fx):
    points = fx("fx_points")
    b = N.nearest_building(points, raw(fx)).select("point_id", F.round("distance", 3).alias("building"))
    s = N.nearest_street(points, fx("fx_street_points")).select("point_id", F.round("distance", 3).alias("street"))
    a = N.nearest_admin_area(_asked(fx), fx("fx_area_vertices")).select("point_id", F.round("distance", 3).alias("area"))
    return N.nearest_object(b.join(s, "point_id").join(a, "point_id", "left")).select("point_id", "kind")

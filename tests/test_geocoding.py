import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoloom.functions import geometry as G, tags as T, text as X
from geoloom.operators import areas as A, nearest as N, search as S, views as V
from geoloom.plans import queries as geo
from geoloom.plans.fixtures import TABLES
from geoloom.sources import osm, snapshot

SMALL = "/root/testdata/sf0.001"

VECTORS = {
    "Hauptstraße 12": "hauptstrasse 12", "Hauptstr. 12": "hauptstrasse 12", "Müller-Pl.": "mueller platz", "St.-Johannes-Str.": "st johannes strasse",
    "São Paulo Ave.": "sao paulo avenue", "  Haupt--Str. ": "haupt strasse", "Strave": "stravenue", "Nord ÉCOLE str str": "noroad cole strasse strasse",
    "dave": "davenue", "Æø×ÿ": "", "Straße\tΣ": "strasse Σ",
}


def test_normalisation(spark):
    df = spark.createDataFrame([(k, v) for k, v in VECTORS.items()], "raw string, want string").select("*", X.normalize_address(F.col("raw")).alias("got"))
    assert [(r.raw, r.got) for r in df.collect()] == [(r.raw, r.want) for r in df.collect()]
    again = df.select(X.normalize_address(F.col("got")).alias("twice"), "got").collect()
    assert all(r.twice == r.got for r in again)


def test_house_numbers(spark):
    want = {"12a": 12, "12-14": 12, "007": 7, "0": 0, "000": 0, "65535": 65535, "65536": None, "70000": None, " 12": None, "-3": None, "": None, "9" * 50: None, "0" * 50 + "8": 8, "x": None}
    df = spark.createDataFrame([(k,) for k in [*want, None]], "raw string").select("raw", X.house_number(F.col("raw")).alias("n"))
    assert {r.raw: r.n for r in df.collect()} == want | {None: None}


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("closest a b to c", (["a", "b"], ["c"])), ("a to b", (["a", "to", "b"], [])), ("closest to b", ([], [])), ("closest a", ([], [])),
        ("closest a to b to c", (["a"], ["b", "to", "c"])), ("closest a to", (["a"], [])), ("", ([], [])), ("closest", ([], [])),
    ],
)
def test_closest_grammar(spark, words, want):
    row = spark.createDataFrame([(words.split(),)], "w array<string>").select(X.parse_closest(F.col("w")).alias("p")).first().p
    assert (row.from_tokens, row.to_tokens) == want


def buildings(spark, texts):
    rows = [(i, 0.0, 0.0, t, None, None, "") for i, t in texts.items()]
    return spark.createDataFrame(rows, "building_id long, lat double, lon double, street string, house_number int, shop_name string, address string")


def found(spark, texts, *asked, exact=False):
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    index = S.build_index(buildings(spark, texts))
    hits = S.search_exact(queries, index.postings) if exact else S.search_tokens(S.query_tokens(queries), index)
    out = {q: set() for q in asked}
    for r in hits.collect():
        out[asked[r.query_id]].add(r.building_id)
    return out


def test_substring_and_exact_search(spark):
    assert found(spark, {0: "abc"}, "a", "bc", "d") == {"a": {0}, "bc": {0}, "d": set()}
    assert found(spark, {0: "apple street", 1: "banana ave"}, "apple", "banana", "street") == {"apple": {0}, "banana": {1}, "street": {0}}
    assert found(spark, {0: "123 main", 1: "123 maple"}, "123", "main", "maple") == {"123": {0, 1}, "main": {0}, "maple": {1}}
    assert found(spark, {0: "abc", 1: "def"}, "cde", "") == {"cde": set(), "": set()}
    streets = {1: "123 Main Street", 2: "456 Main Street", 3: "123 Elm Street"}
    assert found(spark, streets, "123 Street", "Street 123", "12", exact=True) == {"123 Street": {1, 3}, "Street 123": {1, 3}, "12": set()}


SHAPES = [  # an L, and an area of two rings of which one lies in the other
    (8, 1, "L", 0, [(0, 0), (0, 4), (2, 4), (2, 2), (4, 2), (4, 0)]), (8, 2, "two", 0, [(10, 10), (10, 14), (14, 14), (14, 10)]),
    (8, 2, "two", 1, [(11, 11), (11, 12), (12, 12), (12, 11)]), (4, 9, "all", 0, [(-20, -20), (-20, 20), (20, 20), (20, -20)]), (8, 3, "line", 0, [(1, 1), (2, 2)]),
]


def shapes(spark):
    rows = [(lv, a, n, r, p, float(y), float(x)) for lv, a, n, r, ring in SHAPES for p, (y, x) in enumerate(ring)]
    return spark.createDataFrame(rows, "level int, area_id long, name string, ring int, pos int, lat double, lon double")


def test_containment(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 11.5, 11.5), (4, 0.0, 1.0), (5, 50.0, 50.0), (6, 90.0, 181.0)], "point_id long, lat double, lon double")
    got = {(r.point_id, r.level, r.area_id) for r in A.containing(points, shapes(spark)).collect()}
    assert got == {(1, 8, 1), (1, 4, 9), (2, 4, 9), (3, 8, 2), (3, 4, 9), (4, 8, 1), (4, 4, 9)}
    address = {r.point_id: r.address for r in A.build_address(A.assign_admin_areas(points, shapes(spark))).collect()}
    assert address[1] == "all, L, " and 5 not in address
    assert A.containing(points, shapes(spark).limit(0)).count() == 0 == A.containing(points.limit(0), shapes(spark)).count()


@pytest.mark.parametrize("spread", [1.0, 1e-7])
def test_grid_neighbours_equal_brute_force(spark, spread):
    r = random.Random(3)
    targets = [(i, r.random() * 1e-4, r.random() * spread) for i in range(300)] + [(1000 + i, 5 + r.random(), 5.0) for i in range(20)] + [(2000, 5.0, 5.0), (1999, 5.0, 5.0)]
    points = [(i, r.uniform(-1, 7), r.uniform(-1, 7)) for i in range(200)] + [(900, 5.0, 5.0), (901, None, 1.0)]
    t = spark.createDataFrame(targets, "target_id long, lat double, lon double")
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    got = {x.point_id: x.target_id for x in N.find_nearest(p, t).collect()}
    want = {i: min(((y - b) ** 2 + (x - a) ** 2, k) for k, b, a in targets)[1] for i, y, x in points if y is not None}
    assert got == want and got[900] == 1999
    assert N.find_nearest(p, t.limit(0)).count() == 0 == N.find_nearest(p.limit(0), t).count()


def test_projection_is_clamped(spark):
    row = spark.range(1).select(G.mercator_y(F.lit(90.0)).alias("top"), G.mercator_y(F.lit(85.0)).alias("edge"), G.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("far")).first()
    assert row.top == row.edge and abs(row.far - math.pi * 6371000) < 1e-3


def test_admin_levels(spark):
    want = {"8": 8, " 6": 6, "+4": 4, "8;9": 8, "x": None, "-1": None, "300": None, "99999999999": None, "255": 255}
    df = spark.createDataFrame([({"admin_level": k},) for k in want], "tags map<string,string>").select("tags", T.admin_level(F.col("tags")).alias("n"))
    assert {r.tags["admin_level"]: r.n for r in df.collect()} == want


XML = """<osm><node id="1" lat="1.0" lon="1.0"><tag k="shop" v="x"/><tag k="name" v="N"/><tag k="name" v="again"/></node><node id="2" lat="1.0" lon="2.0"/>
<node id="3" lat="2.0" lon="2.0"/><node id="4" lat="2.0" lon="1.0"/><node id="5" lat="95.0" lon="1.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="77"/><nd ref="5"/><tag k="highway" v="y"/><tag k="name" v="Way"/></way>
<way id="11"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="no"/></way>
<way id="12"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way><way id="13"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way>
<way id="14"><nd ref="88"/><tag k="highway" v="y"/><tag k="name" v="Empty"/></way>
<relation id="20"><member type="way" ref="12" role="outer"/><member type="way" ref="13" role=""/><tag k="type" v="multipolygon"/><tag k="boundary" v="administrative"/><tag k="name" v="Town"/><tag k="admin_level" v="8"/></relation>
<relation id="21"><member type="way" ref="12" role="outer"/><tag k="type" v="boundary"/><tag k="boundary" v="administrative"/><tag k="name" v="Open"/><tag k="admin_level" v="8"/></relation></osm>"""


def test_map_file(spark, tmp_path):
    (tmp_path / "m.osm").write_text(XML)
    nodes, ways, relations = osm.scan_osm(spark, str(tmp_path / "m.osm"))
    assert nodes.count() == 5 and nodes.where("id = 1").first().tags == {"shop": "x", "name": "N"}
    assert [(b.building_id, b.shop_name) for b in osm.node_buildings(nodes).collect()] == [(1, "N")]
    areas = osm.assemble_areas(ways, relations, nodes)
    assert sorted({(r.area_id, r.ring) for r in areas.collect()}) == [(22, 0), (41, 0)]
    b = osm.area_buildings(areas).first()
    assert (b.building_id, b.lat, b.lon) == (22, 7.0 / 5, 7.0 / 5)
    town = osm.area_admins(areas).collect()
    assert {(r.level, r.area_id, r.name) for r in town} == {(8, 41, "Town")} and len(town) == 5
    streets = sorted((r.name, r.pos) for r in osm.way_streets(ways, nodes).where("name = 'Way'").collect())
    assert streets == [("Way", 0), ("Way", 1)] and osm.way_streets(ways, nodes).where("name = 'Empty' and pos is null").count() == 1


def test_snapshot(spark, tmp_path):
    df = spark.range(3)
    snapshot.snapshot_write({"t": df}, str(tmp_path))
    assert sorted(r.id for r in snapshot.snapshot_read(spark, str(tmp_path), {"t": df.schema})["t"].collect()) == [0, 1, 2]
    with pytest.raises(Exception):
        snapshot.snapshot_read(spark, str(tmp_path / "none"), {"t": df.schema})["t"].collect()


def test_views_of_all_sizes(spark):
    r = random.Random(5)
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)] + [(900, None, 1.0), (901, 10.0, 20.0)]
    views = [(1, -90.0, -180.0, 90.0, 180.0), (2, 10.0, 20.0, 10.0, 20.0), (3, 0.0, 0.0, 45.0, 90.0), (4, 5.0, 5.0, 1.0, 9.0), (5, 10.0, 9.0, 11.0, 21.0), (6, None, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    v = spark.createDataFrame(views, "view_id long, sw_lat double, sw_lon double, ne_lat double, ne_lon double")
    got = sorted((x.view_id, x.point_id) for x in V.in_views(p, v).collect())
    want = sorted((k, i) for k, a, b, c, d in views if a is not None for i, y, x in points if y is not None and a <= y <= c and b <= x <= d)
    assert got == want and len(got) > 300
    assert V.in_views(p, v.limit(0)).count() == 0
    # frames of all sizes meet the areas whose centre they reach
    rows = [(lv, i, f"a{i}", 0, k, y + dy * s, x + dx * s) for lv, s in ((4, 3.0), (8, 0.1)) for i in range(30) for y, x in [(r.uniform(-60, 60), r.uniform(-170, 170))] for k, (dy, dx) in enumerate([(0, 0), (0, 1), (1, 1)])]
    shape = spark.createDataFrame(rows, "level int, area_id long, name string, ring int, pos int, lat double, lon double")
    box = A.boxes(shape).collect()
    wide = {n: (max((b.tr_x - b.bl_x) / 2 for b in box if b.level == n), max((b.tr_y - b.bl_y) / 2 for b in box if b.level == n)) for n in (4, 8)}
    frames = spark.createDataFrame([(1, -1.9e7, -1.9e7, 1.9e7, 1.9e7), (2, 0.0, 0.0, 5e6, 2e5), (3, 1e6, 1e6, 1e6, 1e6)], "f long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((x.f, x.level, x.area_id) for x in N.centred(frames, A.boxes(shape)).collect())
    inside = lambda f, b: f.x0 - wide[b.level][0] <= b.center_x <= f.x1 + wide[b.level][0] and f.y0 - wide[b.level][1] <= b.center_y <= f.y1 + wide[b.level][1]
    assert got == sorted((f.f, b.level, b.area_id) for f in frames.collect() for b in box if inside(f, b)) and got


def test_views_and_zooms(spark):
    row = spark.range(0, 20).select("id", V.zoom_to_level(F.col("id")).alias("l"), *V.dynamic_layers(F.col("id"))).collect()
    assert [r.l for r in row][:13] == [1, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, None] and row[13].streets and not row[14].buildings and row[12].areas
    kinds = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 1.0, 2.0, 1.0), (3, None, 1.0, 1.0), (4, None, None, None), (5, 1.0, 2.0, 0.5)], "point_id long, building double, street double, area double")
    assert {r.point_id: r.kind for r in N.nearest_object(kinds).collect()} == {1: "street", 2: "building", 3: "area", 4: None, 5: "area"}


def plain(rows, columns):
    def value(v):
        if v is None or v != v or str(v) == "<NA>":
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v

    return sorted(repr([value(r[c]) for c in columns]) for r in rows)


@pytest.mark.parametrize(
    "name", ["scan_osm", "search_two_sided", "buildings_in_view", "haversine", "zoom_to_level", "search_inverted", "search_suffix", "nearest_admin_area", "nearest_street", "point_in_polygon", "edge_bins", "admin_areas_in_view", "streets_in_view", "preprocess", "normalize_address", "node_building", "area_admin"]
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in [*TABLES, "documents"]:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = geo.QUERIES[name](spark, SMALL)
    want = con.execute(geo.SQL[name]).df().to_dict("records")
    columns = sorted(got.columns)
    assert columns == sorted(want[0]) and plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


def test_registry(spark):
    assert set(geo.QUERIES) == set(geo.SQL) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_have_no_nested_loops(spark):
    def fx(name):  # without the fixture's own cross joins
        df = geo.fixture(spark, SMALL, name)
        return spark.createDataFrame(df.collect(), df.schema)

    for df in (A.containing(fx("fx_points"), fx("fx_area_vertices")), V.in_views(fx("fx_points"), fx("fx_views")), S.search_two_sided(fx("fx_queries"), S.build_index(buildings(spark, {1: "a"})))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan

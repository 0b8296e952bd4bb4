import struct
import zlib

from pyspark.sql import functions as F

from geoloom.operators.areas import containing
from geoloom.sources import osm, pbf
from geoloom.streaming.clicks import areas_of_clicks, buildings_of_clicks
from test_geocoding import SHAPES, XML, shapes


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


zig = lambda n: n << 1 if n >= 0 else (-n << 1) - 1


def deltas(values):
    return b"".join(varint(zig(b - a)) for a, b in zip([0, *values], values))


def packed(values):
    return b"".join(map(varint, values))


def blob(kind, data, deflate=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if deflate else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_binary_map_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pbf, "TASK_BYTES", 10)
    strings = field(1, b"".join(field(1, s.encode()) for s in ["", "name", "Wäy", "type", "boundary", "outer"]))
    dense = field(1, deltas([5, 3])) + field(8, deltas([-10_000_000, 20_000_000])) + field(9, deltas([15_000_000, -1])) + field(10, packed([1, 2, 0, 0]))
    node = field(1, zig(-9)) + field(2, packed([3])) + field(3, packed([4])) + field(8, zig(1)) + field(9, zig(2))
    way = field(1, 7) + field(2, packed([1])) + field(3, packed([2])) + field(8, deltas([5, 3, 5]))
    relation = field(1, 8) + field(2, packed([3])) + field(3, packed([4])) + field(8, packed([5])) + field(9, deltas([7])) + field(10, packed([1]))
    one = strings + field(2, field(2, dense) + field(1, node))
    two = strings + field(2, field(3, way)) + field(2, field(4, relation))
    path = tmp_path / "m.osm.pbf"
    path.write_bytes(blob("OSMHeader", b"") + blob("OSMData", one) + blob("OSMData", two, deflate=False))
    nodes, ways, relations = pbf.scan_pbf(spark, str(path))
    assert sorted((r.id, r.lat, r.lon, dict(r.tags)) for r in nodes.collect()) == [(-9, 1e-7, 2e-7, {"type": "boundary"}), (3, 2.0, -1e-7, {}), (5, -1.0, 1.5, {"name": "Wäy"})]
    assert [(r.id, r.refs, r.tags) for r in ways.collect()] == [(7, [5, 3, 5], {"name": "Wäy"})]
    r = relations.first()
    assert (r.id, [tuple(m) for m in r.members], r.tags) == (8, [("way", 7, "outer")], {"type": "boundary"})
    assert osm.resolve_way_locations(ways, nodes).count() == 3


def test_compressed_map_file(spark, tmp_path):
    import bz2

    (tmp_path / "m.osm.bz2").write_bytes(bz2.compress(XML.encode()))
    nodes, ways, relations = osm.scan_osm(spark, str(tmp_path / "m.osm.bz2"))
    assert (nodes.count(), ways.count(), relations.count()) == (5, 5, 2)


def test_streams_of_clicks(spark, tmp_path):
    assert SHAPES
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0)], "point_id long, lat double, lon double")
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    areas_of_clicks(stream, shapes(spark)).writeStream.format("memory").queryName("clicked").option("checkpointLocation", str(tmp_path / "c1")).start().processAllAvailable()
    order = ["point_id", "level", "area_id", "name"]
    assert sorted(map(tuple, spark.table("clicked").select(order).collect())) == sorted(map(tuple, containing(points, shapes(spark)).select(order).collect()))
    buildings = spark.range(3).select(F.col("id").alias("building_id"), (F.col("id") * 1.0).alias("lat"), (F.col("id") * 1.0).alias("lon"))
    out = []
    buildings_of_clicks(stream, buildings, lambda df, n: out.extend(tuple(r) for r in df.select("point_id", "building_id").collect()), str(tmp_path / "c2")).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert sorted(out) == [(1, 1), (2, 2)]

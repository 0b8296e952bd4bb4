"""Open map data: XML scans, way geometry, area assembly, and what becomes a building, a street or an area.

nodes: id, lat, lon, tags. ways: id, refs, tags. relations: id, members (type, ref, role), tags.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tags as T

_TAG = "array<struct<_k:string,_v:string>>"
_NODE = f"_id long, _lat double, _lon double, tag {_TAG}"
_WAY = f"_id long, nd array<struct<_ref:long>>, tag {_TAG}"
_RELATION = f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag {_TAG}"


def tag_map(tag: Column) -> Column:
    """Entries (_k, _v) as a map; of entries that repeat a key the first counts."""
    keys = F.transform(tag, lambda t: t["_k"])
    first = F.filter(tag, lambda t, i: F.array_position(keys, t["_k"]) == i + 1)
    return F.coalesce(F.map_from_entries(F.transform(first, lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>"))


def scan_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of an OSM XML file (gzip and bzip2 by their suffix)."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", _NODE).select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tag_map(F.col("tag")).alias("tags"))
    ways = read("way", _WAY).select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tag_map(F.col("tag")).alias("tags"))
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = read("relation", _RELATION).select(F.col("_id").alias("id"), members.alias("members"), tag_map(F.col("tag")).alias("tags"))
    return nodes, ways, relations


def resolve_way_locations(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, lat, lon): the located nodes of each way. Missing nodes and those without a valid place are left out."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    valid = nodes.where("lat between -90 and 90 and lon between -180 and 180").select(F.col("id").alias("ref"), "lat", "lon")
    return refs.join(valid, "ref").select("id", "pos", "lat", "lon")


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """Joins a relation's outer ways end to end into closed rings. One that does not close gives no rings at all."""
    left = [list(r) for r in rows.sort_values("way")["refs"] if len(r) > 1]
    rings = []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            for i, way in enumerate(left):
                if way[0] == ring[-1] or way[-1] == ring[-1]:
                    ring += (way if way[0] == ring[-1] else way[::-1])[1:]
                    del left[i]
                    break
            else:
                return pd.DataFrame({"id": pd.Series([], dtype="int64"), "ring": pd.Series([], dtype="int32"), "refs": pd.Series([], dtype=object)})
        rings.append(ring)
    return pd.DataFrame({"id": rows["id"].iloc[0], "ring": range(len(rings)), "refs": rings})


def assemble_areas(ways: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area_id, tags, ring, pos, lat, lon): outer rings of closed ways and of multipolygon and boundary relations.

    area_id is twice the way's id, or twice the relation's plus one. Rings keep their closing vertex; areas without a
    located vertex do not appear."""
    closed = ways.where("size(refs) > 3 and element_at(refs, 1) = element_at(refs, -1)").select(
        (F.col("id") * 2).alias("area_id"), "tags", F.lit(0).alias("ring"), "refs"
    )
    wanted = relations.where("tags['type'] in ('multipolygon', 'boundary')")
    outer = wanted.select("id", F.explode("members").alias("m")).where("m.type = 'way' and coalesce(m.role, '') <> 'inner'")
    parts = outer.select("id", F.col("m.ref").alias("way")).join(ways.select(F.col("id").alias("way"), "refs"), "way")
    stitched = parts.groupBy("id").applyInPandas(_stitch, "id long, ring int, refs array<long>")
    rings = stitched.join(wanted.select("id", "tags"), "id").select((F.col("id") * 2 + 1).alias("area_id"), "tags", "ring", "refs")
    every = closed.unionByName(rings)
    keyed = every.select(F.struct("area_id", "ring").alias("id"), "refs")
    placed = resolve_way_locations(keyed, nodes).select("id.area_id", "id.ring", "pos", "lat", "lon")
    return placed.join(every.select("area_id", "ring", "tags"), ["area_id", "ring"]).select("area_id", "tags", "ring", "pos", "lat", "lon")


def vertex_centroids(vertices: DataFrame) -> DataFrame:
    """Mean latitude and longitude over all vertices of an area's outer rings, closing vertices included."""
    return vertices.groupBy("area_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def _building(tags: Column) -> list[Column]:
    return [
        T.street_name(tags).alias("street"), T.tagged_house_number(tags).alias("house_number"), T.shop_name(tags).alias("shop_name"),
    ]


def node_buildings(nodes: DataFrame) -> DataFrame:
    valid = nodes.where(T.is_building(F.col("tags"))).where("lat is not null and lon is not null")
    return valid.select(F.col("id").alias("building_id"), "lat", "lon", *_building(F.col("tags")))


def area_buildings(vertices: DataFrame) -> DataFrame:
    """Buildings among the areas, at their centroid. An area that is both counts as a building only."""
    tags = vertices.where(T.is_building(F.col("tags"))).groupBy("area_id").agg(F.first("tags").alias("tags"))
    return vertex_centroids(vertices).join(tags, "area_id").select(F.col("area_id").alias("building_id"), "lat", "lon", *_building(F.col("tags")))


def way_streets(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(street_id, name, pos, lat, lon): named streets' vertices; a street without any has one row with nulls."""
    named = ways.where(T.is_street(F.col("tags"))).select("id", "refs", T.object_name(F.col("tags")).alias("name"))
    named = drop_unnamed(named)
    placed = named.select("id", "name").join(resolve_way_locations(named, nodes), "id", "left")
    return placed.select(F.col("id").alias("street_id"), "name", "pos", "lat", "lon")


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.where("name is not null")


def area_admins(vertices: DataFrame) -> DataFrame:
    """(level, area_id, name, ring, pos, lat, lon): named administrative areas with a level from 0 to 255."""
    tags = F.col("tags")
    mine = vertices.where(T.is_admin_area(tags) & ~T.is_building(tags))
    named = drop_unnamed(mine.select(T.admin_level(tags).alias("level"), "area_id", T.object_name(tags).alias("name"), "ring", "pos", "lat", "lon"))
    return named.where("level is not null")


def counts(buildings: DataFrame, streets: DataFrame, areas: DataFrame) -> DataFrame:
    """(kind, n): buildings, streets, and administrative areas over all levels."""
    one = lambda df, kind, *key: df.select(*key).distinct().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(buildings, "buildings", "building_id").union(one(streets, "streets", "street_id")).union(one(areas, "admin_areas", "level", "area_id"))

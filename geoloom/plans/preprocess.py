"""The enrichment pipeline: addresses from areas, then street names from the nearest street."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.areas import assign_admin_areas, build_address
from ..operators.nearest import find_nearest
from ..operators.search import build_index
from ..sources.snapshot import snapshot_read, snapshot_write
from .tables import settled


def with_addresses(buildings: DataFrame, vertices: DataFrame) -> DataFrame:
    """buildings (building_id, lat, lon, ...) with their address; outside all areas it is empty."""
    points = buildings.select(F.col("building_id").alias("point_id"), "lat", "lon")
    address = build_address(assign_admin_areas(points, vertices)).withColumnRenamed("point_id", "building_id")
    return buildings.join(address, "building_id", "left").withColumn("address", F.coalesce("address", F.lit("")))


def interpolate_street(buildings: DataFrame, street_points: DataFrame) -> DataFrame:
    """buildings whose null street is the name of the street with the nearest vertex; without streets it stays null."""
    asked = buildings.where("street is null").select(F.col("building_id").alias("point_id"), "lat", "lon")
    targets = street_points.select(F.col("street_id").alias("target_id"), "lat", "lon")
    names = street_points.groupBy(F.col("street_id").alias("target_id")).agg(F.min("name").alias("nearest"))
    found = find_nearest(asked, targets).join(names, "target_id").select(F.col("point_id").alias("building_id"), "nearest")
    return buildings.join(found, "building_id", "left").withColumn("street", F.coalesce("street", "nearest")).drop("nearest")


def preprocess(buildings: DataFrame, street_points: DataFrame, vertices: DataFrame) -> dict[str, DataFrame]:
    """The tables that queries need: buildings, postings, grams of the vocabulary, and gram_counts."""
    enriched = settled(interpolate_street(with_addresses(buildings, vertices), street_points))
    index = build_index(enriched)
    return {"buildings": enriched, "postings": index.postings, "grams": index.grams, "gram_counts": index.gram_counts}


def saved(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables of preprocess() written as a snapshot; gram_counts are counted from the grams written."""
    snapshot_write({k: v for k, v in tables.items() if k != "gram_counts"}, path)
    read = snapshot_read(tables["buildings"].sparkSession, path, {k: v.schema for k, v in tables.items() if k != "gram_counts"})
    snapshot_write({"gram_counts": read["grams"].groupBy("gram").agg(F.count("*").alias("n"))}, path)
    return snapshot_read(tables["buildings"].sparkSession, path, {k: v.schema for k, v in tables.items()})

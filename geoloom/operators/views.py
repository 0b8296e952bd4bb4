"""What a viewport shows. views: view_id, sw_lat, sw_lon, ne_lat, ne_lon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import in_box, mercator_x, mercator_y
from .areas import boxes
from .nearest import centred

#: The zoom up to which each administrative level is shown.
ZOOMS = {2: 1, 4: 2, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8}
#: Degrees of the smallest cells in which views meet points.
CELL = 0.25


def in_views(points: DataFrame, views: DataFrame) -> DataFrame:
    """points (lat, lon, ...) with the view_id of each closed box that holds them. A view meets the points in cells of
    its own size, CELL degrees at least, so it covers four of them at most, and a point has one cell of each size asked
    for."""
    side = F.greatest(F.col("ne_lat") - F.col("sw_lat"), F.col("ne_lon") - F.col("sw_lon"), F.lit(CELL)) / CELL
    own = views.where("sw_lat <= ne_lat and sw_lon <= ne_lon").withColumn("k", F.ceil(F.log2(side)).cast("int"))
    sizes = sorted(r.k for r in own.select("k").distinct().collect() if r.k is not None)  # a dozen, as boxes are on a globe
    if not sizes:
        return points.limit(0).select(F.lit(None).cast(views.schema["view_id"].dataType).alias("view_id"), "*")
    cell = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col("k")) * CELL)).cast("long")
    cover = own.select("*", F.explode(F.sequence(cell("sw_lat"), cell("ne_lat"))).alias("cx"))
    cover = cover.select("*", F.explode(F.sequence(cell("sw_lon"), cell("ne_lon"))).alias("cy")).select("view_id", "sw_lat", "sw_lon", "ne_lat", "ne_lon", "k", "cx", "cy")
    inside = in_box(*(F.col(c) for c in ("lat", "lon", "sw_lat", "sw_lon", "ne_lat", "ne_lon")))
    placed = points.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).withColumns({"cx": cell("lat"), "cy": cell("lon")})
    return placed.join(cover, ["k", "cx", "cy"]).where(inside).select("view_id", *points.columns)


def buildings_in_view(views: DataFrame, buildings: DataFrame) -> DataFrame:
    found = in_views(buildings, views.where("sw_lat <= ne_lat"))
    return found.select(
        "view_id", "building_id", "lat", "lon", F.col("street").isNotNull().alias("has_street"), F.col("house_number").isNotNull().alias("has_house_number")
    )


def streets_in_view(views: DataFrame, street_points: DataFrame) -> DataFrame:
    """(view_id, street_id, name, pos, lat, lon): the whole polyline of every street with a vertex in the view."""
    found = in_views(street_points, views.where("sw_lat <= ne_lat")).select("view_id", "street_id").distinct()
    return found.join(street_points, "street_id").select("view_id", "street_id", "name", "pos", "lat", "lon")


def admin_areas_in_view(views: DataFrame, vertices: DataFrame) -> DataFrame:
    """(view_id, level, area_id, name): areas whose box centre lies in the view widened by the level's largest half
    extents, which are all that meet the view, and some more."""
    frames = views.select(
        "view_id", mercator_x(F.col("sw_lon")).alias("x0"), mercator_y(F.col("sw_lat")).alias("y0"),
        mercator_x(F.col("ne_lon")).alias("x1"), mercator_y(F.col("ne_lat")).alias("y1"),
    )
    return centred(frames, boxes(vertices)).select("view_id", "level", "area_id", "name")


def zoom_to_level(zoom: Column) -> Column:
    out = None
    for most, level in ZOOMS.items():
        out = F.when(zoom <= most, level) if out is None else out.when(zoom <= most, level)
    return out


def areas_for_zoom(areas: DataFrame, zoom: Column) -> DataFrame:
    """areas of the zoom's level; all of them where the zoom has no level."""
    level = zoom_to_level(zoom)
    return areas.where(level.isNull() | (F.col("level") == level))


def dynamic_layers(zoom: Column) -> list[Column]:
    return [(zoom >= 15).alias("buildings"), (zoom >= 13).alias("streets"), (zoom < 13).alias("areas")]


def marker_class(street: Column, house_number: Column) -> Column:
    return F.when(street.isNull(), "grey").when(house_number.isNull(), "green").otherwise("blue")


def result_in_view(results: DataFrame) -> DataFrame:
    """results (label, house_number, lat, lon and a view) with the text shown and whether it lies in the view."""
    text = F.trim(F.concat("label", F.lit(" "), F.coalesce(F.col("house_number").cast("string"), F.lit(""))))
    inside = in_box(*(F.col(c) for c in ("lat", "lon", "sw_lat", "sw_lon", "ne_lat", "ne_lon")))
    return results.withColumns({"shown": F.when(text == "", "(unnamed building)").otherwise(text), "in_view": inside})
